"""SQL scripts: discovery, splitting into statements, dialects and runs with statistics."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.numbering import with_checkpoints

#: A string, an identifier in quotes, a comment, or the end of a statement.
_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)
#: What each dialect has in place of what others write. Applied outside of quotes, in this order.
DIALECTS: dict[str, tuple[tuple[str, str], ...]] = {
    "sqlite": (
        (r"\b[a-zA-Z_]\w*\.(?=[a-zA-Z_\"`])", ""),
        (r"\b(?:BIG)?SERIAL\b", "INTEGER"),
        (r"\bBOOLEAN\b", "INTEGER"),
        (r"\bTRUE\b", "1"),
        (r"\bFALSE\b", "0"),
        (r"\bNOW\(\)", "CURRENT_TIMESTAMP"),
        (r"\bCURRENT_TIMESTAMP\(\)", "CURRENT_TIMESTAMP"),
        (r"\s*\bRETURNING\s+[\w,\s*]+", ""),
    ),
    "postgresql": ((r"\bAUTOINCREMENT\b", "GENERATED BY DEFAULT AS IDENTITY"), (r"\bCURRENT_TIMESTAMP\(\)", "CURRENT_TIMESTAMP"), (r"\b1\s*=\s*1\b", "TRUE")),
    "mysql": ((r"\bAUTOINCREMENT\b", "AUTO_INCREMENT"), (r"\b(?:BIG)?SERIAL\b", "BIGINT AUTO_INCREMENT"), (r"\bCURRENT_TIMESTAMP\b(?!\()", "CURRENT_TIMESTAMP()"), (r"\bTRUE\b", "1"), (r"\bFALSE\b", "0")),
    "spark": ((r"\b(?:BIG)?SERIAL\b", "BIGINT"), (r"\bTEXT\b", "STRING"), (r"\bVARCHAR\(\d+\)", "STRING"), (r"\bDOUBLE PRECISION\b", "DOUBLE"), (r"\bDATETIME\b", "TIMESTAMP"), (r"\bTIMESTAMPTZ\b", "TIMESTAMP"), (r"\bJSONB\b", "STRING")),
}
DIALECTS["mariadb"] = DIALECTS["mysql"]
#: The quotes of identifiers that a dialect writes in another way, and its own.
QUOTES = {"postgresql": ("`", '"'), "mysql": ('"', "`"), "mariadb": ('"', "`")}
log = logging.getLogger(__name__)


def statements(script: str) -> list[str]:
    """The statements of a script without comments; semicolons and dashes in quotes part and begin nothing."""
    out, held, at = [], [], 0
    for m in _PART.finditer(script):
        held.append(script[at : m.start()])
        at = m.end()
        if m[0] == ";":
            out.append("".join(held).strip())
            held = []
        elif m[0].startswith(("--", "/*")):
            held.append(" ")
        else:
            held.append(m[0])
    out.append(("".join(held) + script[at:]).strip())
    return [s for s in out if s]


def is_select(sql: str) -> bool:
    return sql.lstrip().lower().startswith(("select", "with", "(select"))


def normalize(sql: str, dialect: str) -> str:
    """sql in the words and quotes of a dialect, with single spaces; texts in quotes stay, comments go. An unknown
    dialect changes no words, with a warning."""
    if dialect not in DIALECTS:
        log.warning("no rules for the dialect %s", dialect)
    theirs, own = QUOTES.get(dialect, ("", ""))
    held, plain, at = [], [], 0  # what is in quotes stands aside, so that rules see all the rest at once
    for m in _PART.finditer(sql):
        plain.append(sql[at : m.start()])
        at = m.end()
        if m[0] == ";":
            plain.append(";")
        elif m[0].startswith(("--", "/*")):
            plain.append(" ")
        else:
            quoted = m[0][1:-1].join((own, own)) if m[0][0] == theirs else m[0]
            plain.append(f"\0{'s' if quoted[0] == chr(39) else 'n'}{len(held)}\0")
            held.append(quoted)
    text = re.sub(r"\s+", " ", "".join([*plain, sql[at:]])).strip()
    if dialect == "sqlite":  # a schema before a quoted name, or in quotes itself
        text = re.sub(r"(?:\b[a-zA-Z_]\w*|\0n\d+\0)\.(?=[a-zA-Z_\0])", "", text)
    for pattern, new in DIALECTS.get(dialect, ()):
        text = re.sub(pattern, new, text, flags=re.I)
    return re.sub(r"\0[sn](\d+)\0", lambda m: held[int(m[1])], text)


def script_files(path: str) -> list[Path]:
    """The file, or of a folder first its *.sql and then its *.txt by name."""
    p = Path(path)
    if p.is_file():
        if p.suffix not in (".sql", ".txt"):
            raise ValueError(f"not a script: {path}")
        return [p]
    found = [*sorted(p.glob("*.sql")), *sorted(p.glob("*.txt"))]
    if not found:
        raise FileNotFoundError(f"no scripts in {path}")
    return found


def read_script(path: Path) -> str:
    data = path.read_bytes()
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def normalized_statements(script: Column, dialect: str) -> Column:
    """The statements of each row's script, in the words of a dialect; null for null."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else [normalize(x, dialect) for x in statements(s)] for s in batch.to_pylist()], pa.list_(pa.string()))

    return split(script)


def run(spark: SparkSession, scripts: Sequence[tuple[str, str]], stop_on_error: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """Runs (name, script) pairs. The results of selects, and a table of statistics per statement. Every select is
    computed once, as a checkpoint, so that its time and success are those of its run and its result is at hand.
    Scripts stay on the driver; their tables don't."""
    with_checkpoints(spark)
    results, rows = [], []
    for name, script in scripts:
        for number, sql in enumerate(statements(script), 1):
            began, error = time.perf_counter(), None
            try:
                df = spark.sql(normalize(sql, "spark"))
                if is_select(sql):
                    results.append(df.checkpoint())
            except Exception as e:  # noqa: BLE001  reported with the statement
                error = str(e).splitlines()[0][:500]
                if stop_on_error:
                    raise
            rows.append((name, number, sql[:200], error is None, error, (time.perf_counter() - began) * 1000))
    return results, spark.createDataFrame(rows, "script string, number int, statement string, ok boolean, error string, ms double")
