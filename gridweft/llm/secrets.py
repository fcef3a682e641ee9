"""Secret scans with multipart credential linking, in DataFrame operations only.

Patterns propose parts; the pieces that a split by the same pattern leaves give their positions
as running sums. Strong parts are reported as they are. Weak ones (user names, short or generic
secrets, endpoints) are joined by interval with the other parts of their text and reported only
where complementary parts stand within the same scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group whose length counts, least length, a cheap test that a text may hold it, least length as a weak part. The order ranks spans of one start.
PARTS = [
    ("assign", rf"(?i)(password|passwd|secret|token|api_?key){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, (":", "=")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("id", rf"(?i)\b(user(?:_?name|_?id)?|login|client_?id|access_?key(?:_?id)?|account){_SET}([A-Za-z0-9@._-]+)", 2, 3, (":", "=")),
    ("weak", rf"(?i)\b(pass|pwd|pw|auth|credentials?|private_?key|bearer){_SET}([A-Za-z0-9+/_.=-]+)", 2, 4, (":", "=")),
    ("endpoint", r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, 8, ("://",)),
]
BASE = ("assign", "access", "hex")
#: Code points between the starts of parts that can belong to one credential; least length of a value too short for ``assign`` that still counts as weak.
SCOPE, SHORT = 200, 3


def _proposed(text: Column, k: int) -> Column:
    """array<struct<kind, i, gap, len, value>>: the matches of one pattern and the text left before each."""
    _, pattern, group, _, needs = PARTS[k]
    element = "array<struct<kind:int,i:int,gap:int,len:int,value:int>>"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    value = (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length
    parts = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), value(x["m"]).alias("value")))
    may = F.lit(True)
    if needs:
        may = F.contains(text, F.lit(needs[0]))
        for n in needs[1:]:
            may = may | F.contains(text, F.lit(n))
    may = may & text.rlike(pattern)
    return F.when(may, parts.cast(element)).otherwise(F.array().cast(element))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): per row of docs its reported spans, array<struct<start, kind, name, end>> in order of start, then kind.

    Positions are code points, ends exclusive. Null and empty texts have none; every row counts
    for itself, so repeated rows and null ids give a row each; texts of any length are read whole, an
    empty table gives no rows. Only the two columns are read, whatever else docs has.
    Strong parts (assign, access, hex) are always reported; an ``id`` where a secret starts
    within scope, a ``weak`` secret (also an assigned value under 6 characters) where an
    identifier or endpoint does, an ``endpoint`` where both an identifier and a secret do.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), F.concat(*[_proposed(text, k) for k in range(len(PARTS))]).alias("parts"))
    rows = common.written(rows, "parts")  # fixes the row numbers
    part = rows.where(F.size("parts") > 0).select("id", "row", F.inline("parts"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("start", start)
    name = F.element_at(F.array(*[F.lit(p[0]) for p in PARTS]), F.col("kind") + 1)
    least = F.element_at(F.array(*[F.lit(p[3]) for p in PARTS]), F.col("kind") + 1)
    short = (name == "assign") & (F.col("value") < least) & (F.col("value") >= SHORT)
    weak = [p[0] for p in PARTS].index("weak")
    part = part.withColumn("valid", (F.col("value") >= least) | short).withColumn("kind", F.when(short, weak).otherwise(F.col("kind"))).withColumn("name", name)
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("valid") & F.col("name").isin(*kinds)).over(near)
    part = part.withColumn("near_id", has("access", "id")).withColumn("near_secret", has("assign", "hex", "weak")).withColumn("near_end", has("endpoint"))
    told = F.col("name").isin(*BASE) | ((F.col("name") == "id") & F.col("near_secret")) | ((F.col("name") == "weak") & (F.col("near_id") | F.col("near_end"))) | ((F.col("name") == "endpoint") & F.col("near_id") & F.col("near_secret"))
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", "name", (F.col("start") + F.col("len")).cast("long").alias("end"))
    found = part.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.when(F.col("valid") & told, span))).alias("spans"))
    rest = rows.where(F.size("parts") == 0).select("id", F.array().cast(found.schema["spans"].dataType).alias("spans"))
    return found.select("id", "spans").union(rest).withColumnRenamed("id", id_col)


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
