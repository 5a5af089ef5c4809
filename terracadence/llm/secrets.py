"""Secret scan with linking of credential parts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: Code points that part two intervals of one scope at most.
REACH = 240
_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group whose length counts, least length. The order breaks ties of starts.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # of AKIA[A-Z0-9]+ those of 20 characters and more, as runs are greedy
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Weak candidates: nothing on their own.
WEAK = (
    ("weak_id", r"((?i:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:name)?|login))" + _NAMED + r"([A-Za-z0-9._@+-]+)", 2, 4),
    ("weak_secret", r"((?i:pwd|passphrase|private_?key|auth|credentials?))" + _NAMED + r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("bare_secret", r"[A-Za-z0-9+/]{32,}", 0, 32),
    ("endpoint", r"""((?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3))://([^\x20\x09-\x0D"'<>]+)""", 2, 4),
)
ROLE = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "bare_secret": "secret", "endpoint": "endpoint"}
ORDER = {kind: i for i, (kind, *_) in enumerate(BASE + WEAK)}
SPAN = "struct<start:int,ord:int,stop:int,kind:string>"
#: Matches whose places are added up together.
BLOCK = 128


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, ord, stop, kind), in code points; those whose group is too short are dropped.

    The pieces between matches and the matches alternate, so their lengths add up to the places. They are added up in
    blocks of BLOCK matches, as arrays that grow by one are copied at each step.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        fits = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        if kind == "bare_secret":
            for wanted in ("[0-9]", "[a-z]", "[A-Z]"):
                fits = fits & F.coalesce(x["value"].rlike(wanted), F.lit(False))
        span = F.struct(begin.alias("start"), F.lit(ORDER[kind]).alias("ord"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, parts: Column) -> Column:
        own = F.aggregate(parts, F.struct(acc["at"].alias("at"), _none().alias("out")), step)
        # own is taken once: as the element of an array of one
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

    def spans(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))

    return F.when(text.rlike(pattern), F.transform(F.array(found), spans)[0]).otherwise(_none())


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def linked_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates that have complementary parts within reach: k and an array of spans. docs: (k, t, base).

    All parts of documents with a weak candidate become intervals. A weak candidate, widened by reach, is joined to
    the parts of its document through cells of reach code points; it stays if they hold what it lacks: an identifier
    needs a secret, a secret an identifier, an endpoint both. One that overlaps a base span goes.
    """
    weak = F.concat(*[spans_of(F.col("t"), *w) for w in WEAK])
    rows = docs.withColumn("weak", weak).where(F.size("weak") > 0)
    parts = staged(rows.select("k", F.explode(F.concat("base", "weak")).alias("s")).select("k", "s.*").distinct())  # copies of a row give their parts once
    roles = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    cell = lambda c: F.floor(c / reach).cast("int")
    left = parts.where(F.col("ord") >= len(BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("stop") + reach))))
    right = parts.select("k", F.col("start").alias("start2"), F.col("stop").alias("stop2"), (F.col("ord") < len(BASE)).alias("strong"), roles[F.col("kind")].alias("role"))
    right = right.withColumn("cell", F.explode(F.sequence(cell(F.col("start2")), cell(F.col("stop2")))))
    near = (F.col("start2") <= F.col("stop") + reach) & (F.col("stop2") >= F.col("start") - reach)
    met = left.join(right, ["k", "cell"]).where(near).groupBy("k", "start", "ord", "stop", "kind").agg(
        F.max(F.col("role") == "id").alias("has_id"), F.max(F.col("role") == "secret").alias("has_secret"),
        F.max(F.col("strong") & (F.col("start2") < F.col("stop")) & (F.col("stop2") > F.col("start"))).alias("covered"),
    )
    role = roles[F.col("kind")]
    whole = F.when(role == "id", F.col("has_secret")).when(role == "secret", F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    kept = met.where(whole & ~F.col("covered"))
    return kept.groupBy("k").agg(F.collect_list(F.struct("start", "ord", "stop", "kind")).alias("linked"))  # bounded by the document


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Find secrets in every whole text.

    Returns id, n_assign, n_access, n_hex, base (spans of the strong patterns), found (base and linked weak spans,
    both arrays of start, ord, stop, kind in code points, by start and kind). Null and empty texts have no spans;
    rows that repeat an id and a text get the same answer each; a null id is kept; no rows give none. Long texts are
    searched whole, in time that grows with their length and matches. Other columns, whatever their names, are not read.
    """
    text = text_of(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    base = F.array_sort(F.concat(*[spans_of(F.col("t"), *b) for b in BASE]))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), key.alias("k")).withColumn("base", base)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    out = rows.join(linked_spans(rows, reach), "k", "left")
    found = F.array_sort(F.concat("base", F.coalesce("linked", _none())))
    return out.select(F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k, *_ in BASE], "base", found.alias("found"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """base_sha256 and spans in place of the arrays."""
    others = [c for c in scanned.columns if c not in ("base", "found")]
    return scanned.select(*others, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"))
