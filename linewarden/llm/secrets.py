"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

Besides the patterns, every run of 16 or more token characters that they do not cover is a
hypothesis: it may be an ordinary word, name or identifier. Its encoding is the smallest
alphabet that holds it. Three statistics are taken over that alphabet, and each gives the
probability that ordinary text of this length looks as random:

* chi-squared against uniform use of the alphabet, which text with its uneven letters
  exceeds by an amount that grows with the length;
* runs of character classes (lower, upper, digit): text changes class seldom;
* serial correlation of the class from one character to the next: in text it is high.

A token must look random to all of them, so their largest probability counts, which needs
no independence of the tests. False discoveries are
controlled by the step-up procedure within each stratum of encoding and length class, since
short tokens are many and give weak evidence, long ones are few and give strong evidence.
Only a histogram of probabilities of each stratum, of fixed size, passes the driver.

Defined results: a null text is an empty one; texts are read whole, at any length; repeated
rows and null ids are scanned like any other; an empty table gives no rows. Only doc_id and
text are read; redaction keeps all other columns.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.common import ship_package, stored

# Fixed patterns and least lengths.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Name, characters, size of the alphabet, and the chance that two characters of text in
#: that alphabet agree. The first that holds a token is its encoding.
ENCODINGS = (
    ("word", re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+"), 26, 0.066),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, 0.25),
    ("base32", re.compile(r"[A-Z2-7]+=*"), 32, 0.066),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 36, 0.066),
    ("base62", re.compile(r"[0-9A-Za-z]+"), 62, 0.066),
    ("base64", re.compile(r".*", re.DOTALL), 64, 0.066),
)
#: Of ordinary text: the rate of class changes, the correlation of neighbours' classes.
CHANGES, PERSISTENCE = 0.12, 0.8
FALSE_SHARE = 0.01
#: Probabilities are rounded up to powers of 10 ** (1 / STEPS), down to 10 ** (-MOST / STEPS).
STEPS, MOST = 8, 320

SCAN = (
    "doc_id long, n_assign long, n_access long, n_hex long, "
    "base array<struct<kind:string,start:int,stop:int>>, "
    "tested array<struct<stratum:string,level:int,start:int,stop:int>>"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if any(h in text.lower() for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                spans.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                spans.append(("access", m.start(), m.end()))
    # A run of hex digits that is long enough lies inside a long token.
    for t in TOKEN.finditer(text):
        for m in HEX.finditer(t[0]):
            if m.end() - m.start() >= HEX_LEAST:
                spans.append(("hex", t.start() + m.start(), t.start() + m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _classes(token: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.islower() else 2 for c in token if c.isalnum()]


def uniformity(token: str, size: int, agree: float) -> float:
    """Chance that text has so small a chi-squared, by its noncentral distribution."""
    n = len(token)
    counts: dict[str, int] = defaultdict(int)
    for c in token:
        counts[c] += 1
    chi = sum(v * v for v in counts.values()) * size / n - n
    away = n * max(0.0, size * agree - 1)
    return _normal((chi - (size - 1) - away) / math.sqrt(2 * (size - 1) + 4 * away))


def class_runs(token: str) -> float:
    """Bound on the chance that text changes class so often; a capital begins a word."""
    c = _classes(token)
    n = len(c) - 1
    if n < 1:
        return 1.0
    changes = sum(a != b and not (a == 2 and b == 1) for a, b in zip(c, c[1:], strict=False))
    x = changes / n
    if x <= CHANGES:
        return 1.0
    away = x * math.log(x / CHANGES)
    if x < 1:
        away += (1 - x) * math.log((1 - x) / (1 - CHANGES))
    return math.exp(-n * away)


def serial_correlation(token: str) -> float:
    """Chance that classes of neighbours in text correlate so little, by Fisher's z."""
    c = _classes(token)
    n = len(c)
    mean = sum(c) / n if n else 0.0
    var = sum((x - mean) ** 2 for x in c)
    if n < 5 or var == 0:
        return 1.0
    r = sum((a - mean) * (b - mean) for a, b in zip(c, c[1:], strict=False)) / var
    r = max(-0.99, min(0.99, r))
    return _normal((math.atanh(r) - math.atanh(PERSISTENCE)) * math.sqrt(n - 3))


def battery(token: str) -> tuple[str, int]:
    """Stratum, and the level of the combined probability (higher: less like text)."""
    name, _, size, agree = next(e for e in ENCODINGS if e[1].fullmatch(token))
    body = token.rstrip("=")
    p = max(uniformity(body, size, agree), class_runs(body), serial_correlation(body))
    floor = 10.0 ** (-MOST / STEPS)
    level = min(MOST, int(-math.log10(max(p, floor)) * STEPS))
    return f"{name}:{len(body).bit_length()}", max(0, level)


def tested_tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """stratum, level, start, stop of all long tokens that patterns do not cover."""
    out, i = [], 0
    covers: list[list[int]] = []
    for _, start, stop in base:
        if covers and start <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], stop)
        else:
            covers.append([start, stop])
    for m in TOKEN.finditer(text):
        while i < len(covers) and covers[i][1] < m.end():
            i += 1
        if not (i < len(covers) and covers[i][0] <= m.start()):
            out.append((*battery(m[0]), m.start(), m.end()))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Pattern matches and tested tokens of every document."""
    ship_package(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(f"n_{k}", pa.int64()) for k in KINDS]
        + [
            ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))),
            (
                "tested",
                pa.list_(
                    pa.struct(
                        [
                            ("stratum", pa.string()),
                            ("level", pa.int32()),
                            ("start", pa.int32()),
                            ("stop", pa.int32()),
                        ]
                    )
                ),
            ),
        ]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                row = {"doc_id": doc_id}
                for k in KINDS:
                    row[f"n_{k}"] = sum(s[0] == k for s in base)
                row["base"] = [{"kind": k, "start": s, "stop": e} for k, s, e in base]
                row["tested"] = [
                    {"stratum": t, "level": v, "start": s, "stop": e}
                    for t, v, s, e in tested_tokens(text, base)
                ]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, SCAN)


def thresholds(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[str, int]:
    """Least level of a discovery in each stratum that has one."""
    counts = (
        scanned.select(F.explode("tested").alias("t"))
        .groupBy("t.stratum", "t.level")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    strata: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counts:
        strata[r["stratum"]][r["level"]] = r["n"]
    out = {}
    for stratum, by_level in strata.items():
        total, above = sum(by_level.values()), 0
        for level in sorted(by_level, reverse=True):
            above += by_level[level]
            if total * 10 ** (-level / STEPS) <= share * above:
                out[stratum] = level
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and random: spans of all secrets."""
    scanned = stored(scan(docs), "scanned")
    least = thresholds(scanned)
    text = " OR ".join(f"(x.stratum = '{s}' AND x.level >= {v})" for s, v in sorted(least.items()))
    found = F.expr(f"filter(tested, x -> {text or 'false'})")
    return scanned.withColumn("random", found).drop("tested")


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """Documents with every secret replaced by the mark; all columns stay."""
    least = thresholds(scan(docs))

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([hide(t.as_py(), least, mark) for t in texts], pa.string())

    return docs.withColumn("text", of("text"))


def hide(text: str | None, least: dict[str, int], mark: str) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    spans = [(s, e) for _, s, e in base]
    for stratum, level, s, e in tested_tokens(text, base):
        if level >= least.get(stratum, MOST + 1):
            spans.append((s, e))
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out.append(text[at:s] + mark)
        at = max(at, e)
    return "".join(out) + text[at:]
