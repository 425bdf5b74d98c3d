"""Secret scan: fixed patterns, and a randomness battery with length-aware false-discovery control.

SQL functions only. Base spans come from patterns. Beside them, every token that mixes letters and
digits is put to three tests of one null hypothesis, "its characters are drawn at random from the
alphabet of its inferred encoding": chi-squared uniformity over the alphabet, Wald-Wolfowitz runs above and below the
alphabet's middle, and lag-one serial correlation. Fisher's method joins them into one p-value. Random
tokens have p-values spread evenly; structured ones pile up near zero. For each encoding and length
class the share of random tokens among all tokens of the corpus is read off their larger p-values, and the smallest cut above which the estimated share of structured tokens stays at
``fdr`` decides: short tokens, on which the tests have little power, need a higher p-value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.llm.text import cut, whole

# The base patterns, in the order in which kinds are listed, with the group whose length counts and the least length.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# Encodings, narrowest first: name, the characters it may use, the alphabet in code order.
ENCODINGS = {
    "hex": (r"[0-9a-f]+", "0123456789abcdef"),
    "HEX": (r"[0-9A-F]+", "0123456789ABCDEF"),
    "base32": (r"[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": (r"[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "BASE36": (r"[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base62": (r"[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (r"[0-9A-Za-z+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": (r"[0-9A-Za-z_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
TOKEN = r"[0-9A-Za-z+/_-]{12,}={0,2}"
#: p-values are counted on a grid of this many cells, lengths in classes that double.
CELLS = 200
#: Above this p-value all tokens count as random when their share is estimated.
SPREAD = 0.3


def _spans(t: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<start,end,kind,found>> of the leftmost non-overlapping matches; the gaps between
    them, from a split by the same pattern, give the places in code points."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    rows = F.zip_with(F.zip_with(F.split(t, pattern), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))), counted,
                      lambda s, c: F.struct(s["gap"].alias("gap"), s["m"].alias("m"), F.length(c).alias("n")))
    kind_no = list(BASE).index(kind) if kind in BASE else len(BASE)
    empty = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,m:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(x["n"] >= least, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    places = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(found) > 0, places).otherwise(empty)


def base_spans(text: str | Column) -> Column:
    """Base spans by start, then kind as listed."""
    t = whole(text)
    hexes = _spans(t, "hex", r"[0-9a-f]{16,}")  # a run is matched whole, so the least length can be in the pattern
    access = _spans(t, "access", r"AKIA[A-Z0-9]{14,}")  # likewise: what follows a short one in its run is shorter
    return F.array_sort(F.concat(_spans(t, "assign", *BASE["assign"]), access, hexes))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _upper_normal(z: Column) -> Column:
    """Upper tail of the normal law (logistic form, error below 2e-4)."""
    return 1.0 / (1.0 + F.exp(F.greatest(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(500.0)), F.lit(-500.0))))


def encoding(token: Column) -> Column:
    """Narrowest encoding whose alphabet covers the token; null without both a letter and a digit."""
    name = F.lit(None).cast("string")
    for k in reversed(list(ENCODINGS)):
        name = F.when(token.rlike(f"^{ENCODINGS[k][0]}$"), F.lit(k)).otherwise(name)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), name)


def battery(tokens: DataFrame, token: str = "m", code: str = "code") -> DataFrame:
    """``tokens`` with ``p``: Fisher's joint p-value of the three tests, near 0 for structure."""
    alphabet, size = F.lit(""), F.lit(1)
    for k, (_, a) in ENCODINGS.items():
        alphabet = F.when(F.col(code) == k, F.lit(a)).otherwise(alphabet)
        size = F.when(F.col(code) == k, F.lit(len(a))).otherwise(size)
    body = F.regexp_replace(F.col(token), "=+$", "")
    df = tokens.withColumns({"__a": alphabet, "__k": size.cast("double"), "__b": body})
    chars = F.split("__b", "")
    df = df.withColumn("__x", F.transform(chars, lambda c: F.position(c, F.col("__a")).cast("double") - 1))
    n = F.length("__b").cast("double")
    squares = F.aggregate(
        F.array_distinct("__x"), F.lit(0.0),
        lambda s, v: s + F.pow(F.size(F.filter("__x", lambda y: y == v)).cast("double"), F.lit(2.0)))
    df = df.withColumns({"__n": n, "__sq": squares, "__mean": F.aggregate("__x", F.lit(0.0), lambda s, v: s + v) / n})
    high = F.transform("__x", lambda v: (v >= F.col("__k") / 2).cast("int"))
    pairs = F.sequence(F.lit(1), F.size("__x") - 1)
    df = df.withColumn("__h", high).withColumns({
        "__runs": F.aggregate(pairs, F.lit(1.0), lambda s, i: s + (F.element_at("__h", i) != F.element_at("__h", i + 1)).cast("double")),
        "__up": F.aggregate("__h", F.lit(0.0), lambda s, v: s + v),
        "__lag": F.aggregate(pairs, F.lit(0.0), lambda s, i: s + (F.element_at("__x", i) - F.col("__mean")) * (F.element_at("__x", i + 1) - F.col("__mean"))),
        "__var": F.aggregate("__x", F.lit(0.0), lambda s, v: s + (v - F.col("__mean")) * (v - F.col("__mean"))),
    })
    n, k = F.col("__n"), F.col("__k")
    # moments of the chi-squared sum under the multinomial law, exact also where cells expect less than one
    z_chi = (k * F.col("__sq") / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    up, down = F.col("__up"), n - F.col("__up")
    mu = 2 * up * down / n + 1
    sd = F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
    z_runs = F.when((up > 0) & (down > 0), (F.col("__runs") - mu) / sd).otherwise(F.lit(40.0))
    z_lag = F.when(F.col("__var") > 0, (F.col("__lag") / F.col("__var") + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
    logs = [F.log(F.greatest(p, F.lit(1e-30))) for p in (_upper_normal(z_chi), 2 * _upper_normal(F.abs(z_runs)), 2 * _upper_normal(F.abs(z_lag)))]
    half = -F.greatest(F.lit(-200.0), F.least(logs[0] + logs[1] + logs[2], F.lit(0.0)))
    p = F.exp(-half) * (1 + half + half * half / 2)  # chi-squared with six degrees of freedom
    return df.withColumn("p", p).drop("__a", "__k", "__b", "__x", "__n", "__sq", "__mean", "__h", "__runs", "__up", "__lag", "__var")


def thresholds(tokens: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``code``, ``len_class``, ``cut``: the least p-value cell that is reported, from all tokens.

    Above p-value c lie m(c) tokens. The random ones among all are the number above ``SPREAD`` over
    1 - ``SPREAD``, and (1 - c) of them lie above c. ``cut`` is the least c at which the others are at
    most one more than ``fdr`` times m. A class with no token above ``SPREAD`` reports nothing.
    """
    cells = tokens.groupBy("code", "len_class", F.least(F.floor(F.col("p") * CELLS), F.lit(CELLS - 1)).alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy("code", "len_class").orderBy(F.desc("cell"))
    whole_class = Window.partitionBy("code", "len_class")
    random = F.sum(F.when(F.col("cell") >= SPREAD * CELLS, F.col("m")).otherwise(0)).over(whole_class) / (1 - SPREAD)
    above = F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, 0))
    excess = above - random * (1 - F.col("cell") / CELLS)
    ok = (random > 0) & (excess <= fdr * above + 1)
    return cells.withColumn("ok", ok).where("ok").groupBy("code", "len_class").agg(F.min("cell").alias("cut"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep`` columns, ``base`` and ``spans``: arrays of (start, no, end, kind, m) by start.

    ``spans`` are the base ones and tokens of kind ``random`` that overlap none. Places are code
    points, the end exclusive. Null and empty texts have none. Keys may be null or repeat; every row is
    answered. The text is read once; only spans are stored.
    """
    t = whole(text)
    rows = docs.select(F.col(key), *keep, base_spans(t).alias("base"), _spans(t, "random", TOKEN).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = rows.withColumn("more", F.when(F.size("more") > 0, F.filter(apart, lambda m: encoding(m["m"]).isNotNull())).otherwise(F.col("more")))
    rows = cut(rows.withColumn("row", F.when(F.size("more") > 0, F.expr("uuid()"))))
    each = rows.where(F.size("more") > 0).select("row", F.explode("more").alias("s"))
    tested = battery(each.select("row", "s", F.col("s.m").alias("m")).withColumn("code", encoding(F.col("m"))))
    tested = cut(tested.withColumn("len_class", F.floor(F.log2(F.length("m"))).cast("int")))
    # at most one row for each encoding and length class
    limits = F.broadcast(thresholds(tested, fdr))
    passed = tested.join(limits, ["code", "len_class"]).where(F.floor(F.col("p") * CELLS) >= F.col("cut"))
    found = passed.groupBy("row").agg(F.collect_list("s").alias("found"))
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,m:string>>")
    plain = rows.where(F.col("row").isNull()).withColumn("spans", F.col("base"))
    mixed = rows.where(F.col("row").isNotNull()).join(found, "row", "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce("found", none)))).drop("found")
    return plain.unionByName(mixed).select(key, *keep, "base", "spans")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """Text with each span replaced; spans that overlap the one before are covered by it as far as they reach."""
    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.when(fresh, F.concat(s["out"], text.substr(s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
