"""Secret scans with built-in functions only.

Three fixed patterns give the base spans. The method adds spans: candidate strings are
slid over by a window whose Shannon entropy is kept by incremental counts; a candidate is
a secret if some window reaches the threshold of its character class and no allow-list
pattern suppresses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import matches

# The three base kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window must reach, by class of the whole candidate: hexadecimal, letters and digits, base64.
THRESHOLDS = {"^[0-9a-fA-F]+$": 3.0, "^[A-Za-z0-9]+$": 3.6, "^[A-Za-z0-9+/_=-]+$": 3.8}
#: A candidate that holds one of these is not a secret.
ALLOWED = ("(?i)example|sample|placeholder|dummy|changeme|redacted|lorem|xxxx|https?/|www", "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "(?i)0123456|abcdefg", "^[A-Za-z_/+=-]*$", "^[0-9_/+=-]*$", "^([A-Za-z]+|[0-9]+)([-_/]([A-Za-z]+|[0-9]+))*$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of any `window` successive characters; null for shorter strings.

    A fold over the characters keeps one count per character and the sum of c log2 c:
    each step adds the entering and removes the leaving character, so a step costs the
    same however long the string is.
    """
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    gone = F.concat(F.array_repeat(F.lit(0), window), at)
    steps = F.zip_with(at, F.slice(gone, F.lit(1), F.size(at)), lambda i, o: F.struct(i.alias("i"), o.alias("o")))
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    f = lambda n: F.element_at(table, (n + 1).cast("int"))
    none = F.array_repeat(F.lit(0), len(_ALPHABET))
    start = F.struct(none.alias("n"), F.lit(0).alias("seen"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        came = F.element_at(a["n"], F.greatest(x["i"], F.lit(1)))
        counts = F.transform(a["n"], lambda c, j: c + F.when(j + 1 == x["i"], 1).otherwise(0))
        left = F.when(x["o"] > 0, F.element_at(counts, F.greatest(x["o"], F.lit(1)))).otherwise(F.lit(0))
        after = F.when(x["o"] > 0, F.transform(counts, lambda c, j: c - F.when(j + 1 == x["o"], 1).otherwise(0))).otherwise(counts)
        s = a["s"] + f(came + 1) - f(came) + F.when(x["o"] > 0, f(left - 1) - f(left)).otherwise(F.lit(0.0))
        seen = F.least(a["seen"] + 1, F.lit(window))
        best = F.when(seen == window, F.greatest(a["best"], F.lit(math.log2(window)) - s / window)).otherwise(a["best"])
        return F.struct(after.alias("n"), seen.alias("seen"), s.alias("s"), best.alias("best"))

    return F.aggregate(steps, start, step, lambda a: F.when(a["best"] >= 0, a["best"]))


def is_secret(value: Column) -> Column:
    """Whether a candidate passes the allow-list and the entropy threshold of its class."""
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(p))
    least = F.lit(None).cast("double")
    for p, bits in reversed(THRESHOLDS.items()):
        least = F.when(F.rlike(value, F.lit(p)), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(value) >= least)


def secret_spans(text: Column) -> tuple[Column, Column]:
    """(base spans as array<struct<start, kind, end>>, candidates of the method as matches).

    Code points, end exclusive; kind is an index into KINDS. A null text has none. scan() leaves out
    candidates that a base span overlaps, so that base spans stay as they are.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2))
    assign = F.filter(matches(text, ASSIGN), lambda m: value(m) >= ASSIGN_LEAST)
    tagged = lambda found, k: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    base = F.concat(tagged(assign, 0), tagged(matches(text, ACCESS), 1), tagged(matches(text, HEX), 2))
    return base, matches(text, CANDIDATE)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `spans`: array<struct<start bigint, kind string, end bigint>>, to the rows of docs.

    No shuffle and no Python: each row is scanned where it lies, whole. Repeated rows give
    repeated results, other columns pass through, an empty table gives no rows.
    """
    base, candidates = secret_spans(F.col(text))
    step = docs.withColumn("_base", base).withColumn("_more", candidates)
    clear = lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
    more = F.filter("_more", lambda m: clear(m) & F.coalesce(is_secret(m["value"]), F.lit(False)))
    more = F.transform(more, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"))
    return step.withColumn("spans", F.transform(F.array_sort(F.concat("_base", more).cast(_SPANS)), named)).drop("_base", "_more")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans), one row per input row."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
