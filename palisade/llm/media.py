"""Media columns: a Spark data source over archives of media members, and features of what it reads."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from palisade.llm.spans import map_texts, shared_dir

#: Payloads are padded with bytes 255 to a positive multiple of this; a picture row has WIDTH samples.
UNIT, WIDTH = 576, 24
#: An archive is closed beyond this size; a read partition covers this many bytes of one.
ROLL_BYTES, RANGE_BYTES = 256 << 20, 32 << 20
#: Members and bytes of an Arrow batch, and times that a member is read before the task fails.
BATCH_MEMBERS, BATCH_BYTES, ATTEMPTS = 256, 8 << 20, 3


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI; any that Arrow knows (local, hdfs, s3, gcs)."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Archives(WriterCommitMessage):
    """What a write task has finished: archive names and sizes."""

    files: list


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (name, media) as tar archives, each with an index of its members.

    A job's archives bear its id, and its commit adds a list of those that
    committed tasks wrote: what is read is all lists' archives, so jobs append
    to each other, and repeated, lost and failed attempts leave nothing that is
    read. Their files go when the job ends, or by sweep() if the driver is lost.
    An overwriting job takes earlier lists away once its own stands.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, index, at, name = [], None, [], 0, ""

        def close():
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as idx:
                idx.write(np.array(index, dtype="<i8").tobytes())
            files.append([name, at])

        for batch in iterator:
            for member, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if out is not None and at >= ROLL_BYTES:
                    close()
                    out = None
                if out is None:
                    name, index, at = f"{self.job}-{uuid.uuid4().hex}.tar", [], 0
                    out = fs.open_output_stream(f"{root}/{name}")
                info = tarfile.TarInfo(member)
                info.size = len(media)
                block = info.tobuf(tarfile.PAX_FORMAT) + media + b"\0" * (-len(media) % 512)
                index.append((at, len(block), zlib.crc32(block)))
                out.write(block)
                at += len(block)
        if out is not None:
            close()
        return Archives(files)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        earlier = lists_of(fs, root)
        files = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{root}/_aside-{self.job}") as out:
            out.write(json.dumps(files).encode())
        fs.move(f"{root}/_aside-{self.job}", f"{root}/_list-{self.job}.json")
        self._remove(fs, root, {f"{self.job}-"}, {name for name, _ in files})
        if self.overwrite:
            for name in earlier:
                fs.delete_file(f"{root}/{name}")
            self._remove(fs, root, {name[6:-5] + "-" for name in earlier}, set())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        self._remove(fs, root, {f"{self.job}-"}, set())

    @staticmethod
    def _remove(fs, root: str, jobs: set[str], but: set[str]) -> None:
        """Delete the jobs' archives and indexes, except those named."""
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name[:33] in jobs and f.base_name.removesuffix(".idx") not in but:
                fs.delete_file(f.path)


def lists_of(fs: pafs.FileSystem, root: str) -> list[str]:
    """Names of the lists that committed jobs have left."""
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("_list-") and f.base_name.endswith(".json"))


def sweep(path: str, older_s: float = 7 * 86400) -> int:
    """Delete archives of jobs that never committed and wrote nothing for so long; the number of files deleted."""
    fs, root = filesystem(path)
    jobs, gone = {name[6:-5] for name in lists_of(fs, root)}, 0
    before = time.time() - older_s
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.endswith((".tar", ".idx")) and f.base_name[:32] not in jobs and f.mtime.timestamp() < before:
            fs.delete_file(f.path)
            gone += 1
    return gone


@dataclass
class ByteRange(InputPartition):
    """Members of one archive that begin in [start, stop)."""

    name: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    """Plans byte ranges over archives from their sizes; reads the members of a range by offset."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        fs, root = filesystem(self.path)
        files = []
        for name in lists_of(fs, root):
            with fs.open_input_stream(f"{root}/{name}") as f:
                files += json.loads(f.read())
        ranges = [ByteRange(n, a, min(a + self.range_bytes, size)) for n, size in files for a in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def _member(self, fs, path: str, offset: int, length: int, crc: int) -> tuple[str, bytes]:
        """One member; each attempt opens the archive anew and seeks to the offset."""
        error: Exception | None = None
        for _ in range(ATTEMPTS):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(offset)
                    block = f.read(length)
                return self._checked(block, length, crc)
            except (OSError, tarfile.TarError) as e:
                error = e
        raise OSError(f"member at offset {offset} of {path} can't be read: {error}")

    @staticmethod
    def _checked(block: bytes, length: int, crc: int) -> tuple[str, bytes]:
        if len(block) != length or zlib.crc32(block) != crc:
            raise OSError("checksum differs")
        with tarfile.open(fileobj=io.BytesIO(block), mode="r:") as tar:
            info = tar.next()
            return info.name, tar.extractfile(info).read()

    def read(self, partition):
        if not partition.name:
            return
        fs, root = filesystem(self.path)
        path = f"{root}/{partition.name}"
        with fs.open_input_stream(f"{path}.idx") as f:
            index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 3)
        index = index[(index[:, 0] >= partition.start) & (index[:, 0] < partition.stop)]
        held: list[tuple[str, int, str, bytes]] = []
        size = 0
        with fs.open_input_file(path) as f:
            for offset, length, crc in index.tolist():
                try:
                    f.seek(offset)
                    name, media = self._checked(f.read(length), length, crc)
                except (OSError, tarfile.TarError):
                    name, media = self._member(fs, path, offset, length, crc)
                held.append((partition.name, offset, name, media))
                size += length
                if len(held) >= BATCH_MEMBERS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        types = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["archive", "offset", "name", "media"])


class MediaArchive(DataSource):
    """Format `media_archive`: read gives (archive, offset, name, media); write takes (name, media)."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "archive string, offset long, name string, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], overwrite)


def payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), padded with 255 to a positive multiple of UNIT."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return body + b"\xff" * (UNIT - len(body) % UNIT if len(body) % UNIT or not body else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """A grey 8-bit picture, WIDTH samples wide, that holds the bytes as they are."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    plain = np.hstack([np.zeros((len(rows), 1), dtype=np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain, 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples (height, width) of a picture made by to_png."""
    at, packed, shape = 8, b"", (0, 0)
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged picture")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
            shape = (height, width)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(shape[0], shape[1] + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and contrast between rows, then shares of 16 brightness bands in thousandths."""
    bands = np.bincount(samples.ravel() >> 4, minlength=16) * 1000 // samples.size
    steps = np.abs(np.diff(samples.astype(np.int16), axis=0)).mean() if len(samples) > 1 else 0.0
    return f"{samples.mean():.3f} {samples.std():.3f} {steps:.3f} " + ",".join(map(str, bands))


def _members():
    return lambda texts: {"media": [to_png(payload(t)) for t in texts]}


def write_media(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Store every row's text as a picture in archives under path, beside what is there or in its place (mode overwrite); the member name holds doc_id (`id-` and its text, or `none`)."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    made = map_texts(docs.select(F.coalesce(F.concat(F.lit("id-"), F.col("doc_id").cast("string")), F.lit("none")).alias("name"), "text"), _members, T.StructType().add("media", "binary"))
    made.write.format("media_archive").mode(mode).save(path)


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, offset, name, media) of every member under path."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangebytes", range_bytes).load(path)


def media_features(members: DataFrame) -> DataFrame:
    """name and what is computed from the stored bytes of each member."""

    def run(batches):
        for batch in batches:
            made: list[tuple] = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = from_png(media)
                data = samples.tobytes()
                n = len(data.rstrip(b"\xff"))  # UTF-8 never holds a byte 255
                made.append((name, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["name", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = zip(*made, strict=True) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return members.select("name", "media").mapInArrow(run, "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and media columns of each row of docs, stored and read back through archives.

    Null and empty texts are one unit of padding; repeated rows are repeated
    members; a null doc_id stays null. Further columns of docs are not read.
    The archives lie in the shared folder.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_media(docs, path)
    got = media_features(read_media(spark, path))
    doc_id = F.when(F.col("name") != "none", F.substring("name", 4, 1 << 20)).cast(docs.schema["doc_id"].dataType)
    return got.select(doc_id.alias("doc_id"), *got.columns[1:])
