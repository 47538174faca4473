"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Candidates are long runs of token characters whose encoding can be inferred: hex, base32 and base36 need a digit,
base36 a letter of one case too, base64 both cases; numbers and words of one case alone are none. Each is tested against its alphabet: chi-squared uniformity, a runs test
about the median symbol, and lag-1 serial correlation; Fisher's method joins the three p-values. Random tokens
have uniform p-values and ordinary ones (identifiers, numbers, paths) pile up near 0. Candidates are counted over
the whole corpus by encoding, length class and p-value; in each class the smallest cut is taken at which the
estimated share of ordinary tokens above it is at most ``fdr``. The estimate takes the candidates above one half
as random ones, which fixes how many random ones lie above any cut.

Defined results: null and empty texts have no spans; offsets count code points, the end is exclusive; a candidate
that overlaps a pattern's span adds nothing; spans come by start, then by kind in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_batches, table, texts

KINDS = ("assign", "access", "hex", "random")

#: The patterns of the base kinds, and the least lengths (of group 2, of the match, of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
_HINTS = ("password", "passwd", "secret", "token", "api")

#: Production parameters: shortest candidate, length classes (their lower ends), bins of p-values, share of false discoveries.
LEAST_RANDOM, CLASSES, BINS, FDR = 20, (20, 24, 32, 48, 64, 128), 200, 0.05
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST_RANDOM)

_ORDER = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_ORDER |= {"base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
_PLACE = {name: {c: k for k, c in enumerate(symbols)} for name, symbols in _ORDER.items()}
_PLACE["base64"] |= {"-": 62, "_": 63}  # the URL-safe form


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> str | None:
    """The narrowest encoding that the token can be of."""
    chars = set(token)
    digit, lower, upper = (any(f(c) for c in chars) for f in (str.isdigit, str.islower, str.isupper))
    if lower and upper:
        return "base64" if chars <= _PLACE["base64"].keys() else None
    if not digit or not (lower or upper):
        return None
    if chars <= set("0123456789abcdef") or chars <= set("0123456789ABCDEF"):
        return "hex"
    if chars <= set(_ORDER["base32"]):
        return "base32"
    return "base36" if token.isalnum() else None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, kind: str) -> float:
    """Fisher's p-value of the three tests; small where the token doesn't look random over its alphabet."""
    place = _PLACE[kind]
    x = np.array([place[c] for c in (token.lower() if kind in ("hex", "base36") else token)], float)
    n, k = len(x), len(_ORDER[kind])
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n) / (k - 1)
    p_chi = _normal_tail((chi ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))) if chi else 1.0  # Wilson-Hilferty
    up = x >= k / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 1 + int((up[1:] != up[:-1]).sum())
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 * 0.5**n
    d = x - x.mean()
    total = float((d * d).sum())
    p_serial = 2 * _normal_tail(abs(float((d[1:] * d[:-1]).sum()) / total) * math.sqrt(n)) if total else 0.0
    h = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))  # half of a chi-squared with 6 degrees
    return math.exp(-h) * (1 + h + h * h / 2)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
    """(encoding, start, end, p-value) of the tokens that no pattern has found. taken: by start."""
    k, reach = 0, -1  # of the spans that start before the token's end, the furthest end
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= a and (kind := encoding(m[0])):
            yield kind, a, b, randomness(m[0], kind)


def thresholds(counts: dict[tuple[str, int], np.ndarray], fdr: float = FDR) -> dict[tuple[str, int], float]:
    """The least p-value that counts as random, by encoding and length class; above 1 where no cut keeps to the rate."""
    out = {}
    for key, bins in counts.items():
        above = bins[::-1].cumsum()[::-1]  # with a p-value at or above the bin's lower end
        cuts = np.arange(len(bins)) / len(bins)
        random = 2 * bins[len(bins) // 2 :].sum() * (1 - cuts)
        false = np.maximum(above - random, 0) / np.maximum(above, 1)
        fits = np.flatnonzero((false <= fdr) & (above > 0) & (cuts <= 0.5))
        out[key] = float(cuts[fits[0]]) if len(fits) else 2.0
    return out


def scan(docs: DataFrame, fdr: float = FDR, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and its spans array<struct<kind, start, end, p>>; p is null for the fixed patterns."""
    scratch = scratch or Scratch(docs.sparkSession)
    raw = scratch.save(map_batches(texts(docs), _scan, "doc_id long, base array<int>, kind array<string>, at array<int>, p array<double>"))
    found = raw.filter(F.size("kind") > 0).select(F.explode(F.arrays_zip("kind", F.col("p").alias("p"), F.sequence(F.lit(0), F.size("kind") - 1).alias("k"))).alias("c"), "at")
    size = F.element_at("at", (2 * F.col("c.k") + 2).cast("int")) - F.element_at("at", (2 * F.col("c.k") + 1).cast("int"))
    group = sum((size >= c).cast("int") for c in CLASSES) - 1
    binned = found.select(F.col("c.kind").alias("kind"), group.alias("class"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[tuple[str, int], np.ndarray] = {}
    for r in binned.groupBy("kind", "class", "bin").count().collect():  # at most encodings x classes x bins
        counts.setdefault((r["kind"], r["class"]), np.zeros(BINS))[r["bin"]] += r["count"]
    cut = thresholds(counts, fdr)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, kinds, at, ps in zip(*(batch.column(c).to_pylist() for c in ("base", "kind", "at", "p"))):
                spans = [(a, k, e, None) for a, k, e in zip(base[::3], base[1::3], base[2::3])]
                spans += [(a, 3, e, p) for a, e, kind, p in zip(at[::2], at[1::2], kinds, ps) if p >= cut[kind, length_class(e - a)]]
                out.append([{"kind": KINDS[k], "start": a, "end": e, "p": p} for a, k, e, p in sorted(spans, key=lambda s: s[:3])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return map_batches(raw, keep, "doc_id long, spans array<struct<kind:string,start:int,end:int,p:double>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, kinds, at, ps = [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            more = [*candidates(text or "", spans)]
            base.append([x for s in spans for x in s])
            kinds.append([c[0] for c in more])
            at.append([x for c in more for x in c[1:3]])
            ps.append([c[3] for c in more])
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, ints), pa.array(kinds, pa.list_(pa.string())), pa.array(at, ints), pa.array(ps, pa.list_(pa.float64()))], names=["doc_id", "base", "kind", "at", "p"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
