"""Short lines and line ends of the cross-site line dedup."""

from palisade.llm import lines


def test_short_lines_on_many_sites(spark):
    rows = [(100 * n + i, f"Read {n}\nown text {n} {i}\n\n \t", f"s{i % n}") for n in (6, 9, 10, 11, 40) for i in range(50)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for doc_id, text, _ in rows:
        n, i = divmod(doc_id, 100)
        gone = n >= lines.SHORT_SITES and i > 0
        assert got[doc_id].n_removed == gone and got[doc_id].n_lines == 4
        assert got[doc_id].text == (text.split("\n", 1)[1] if gone else text)


def test_line_ends_do_not_count(spark):
    common = "This notice appears on some sites."
    ends = ["", "\r", "\t", " \t\r", ""]
    rows = [(i, f"own {i}\n\t{common}{e}", f"s{i}") for i, e in enumerate(ends)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: rows[i][1] if i == 0 else f"own {i}" for i in range(5)}
