"""Control-plan operators: linting, exposure and preflight over many plans."""
