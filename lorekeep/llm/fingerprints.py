"""Document fingerprints by winnowing, and each text beside an edited one.

Built-in Spark functions only. A text's k-grams are its runs of GRAM code points,
each with 32 bits of its hash. Of every WINDOW consecutive k-grams the least hash
is chosen, the rightmost among equal ones; chosen k-grams keep their position. So
any run of GRAM + WINDOW - 1 code points that two texts share gives both the same
chosen hash, wherever it stands. A chosen k-gram is one number, hash x 2**31 -
position, so the least number of a window is the rightmost least hash, and any
position that a text can have fits.

A text is cut into blocks of BLOCK code points, each with the REACH code points
behind it that its last windows see. A block is one row, and each of its k-grams
and windows a column: such expressions are compiled, while functions over arrays
are interpreted for each element. For the same reason the hash of a k-gram is
taken from its bytes as the k-gram slides; a rolling update would need one more
expression for each code point. A task makes the blocks of its texts and
puts them together again, so no shuffle is added.

Likeness of two fingerprints: common distinct hashes over all distinct hashes;
1 if both are empty. Defined cases: null counts as empty; a text of fewer than
GRAM code points is one k-gram, an empty one has an empty fingerprint; fewer
k-grams than WINDOW are one window; rows that repeat are each fingerprinted.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import whole_rows

#: GRAM may be any number, WINDOW is a power of four.
GRAM, WINDOW = 8, 16
#: Code points that a window has beside its first.
REACH = GRAM + WINDOW - 2
#: More than spark.sql.codegen.maxFields (100): Spark then splits the code of these columns into methods that the JVM compiles.
BLOCK = 104
#: A block's k-grams are read from pieces that start so many code points apart, as a substring is found by counting from the start.
PIECE = 16
POSITIONS = 1 << 31
#: The bits of a hash that stand above a position.
HASH = ((1 << 32) - 1) << 31


def _gram(text: str, start: Column | int, at: Column | int) -> Column:
    """The k-gram that starts so many code points into text, at this position."""
    return F.xxhash64(F.substring(text, F.lit(start + 1), F.lit(GRAM))).bitwiseAND(F.lit(HASH)) - F.lit(at)


def chosen(rows: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """(keys, grams): the chosen k-grams of each part of each row, as array<struct<part, block, grams>> in order.

    parts is an array of structs (part, whole, shift, text); shift is added to positions. Texts that are not whole have no
    windows but full ones. The keys tell rows apart.
    """
    cut = F.regexp_extract_all("p.text", F.lit(f"(?s)(?=(.{{1,{BLOCK + REACH}}})).{{1,{BLOCK}}}"), F.lit(1))
    blocks = rows.select(*keys, F.explode_outer(parts).alias("p")).select(*keys, "p.part", "p.whole", "p.shift", F.posexplode_outer(cut).alias("block", "text"))
    held = [*keys, "part", "block"]
    n = F.length("text")
    short = F.col("whole") & (F.col("block") == 0) & (n <= REACH)
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - GRAM, F.lit(0))), lambda i: _gram("text", i, i)))
    blocks = blocks.select(
        *held,
        (F.col("shift") + F.col("block") * BLOCK).cast("bigint").alias("first"),
        F.greatest(n - REACH, F.lit(0)).alias("windows"),
        F.when(short, F.array(least)).alias("one"),
        *[F.substring("text", i + 1, PIECE + GRAM - 1).alias(f"t{i}") for i in range(0, BLOCK + WINDOW - 1, PIECE)],
    )
    blocks = blocks.select(*held, "first", "windows", "one", *[_gram(f"t{i - i % PIECE}", i % PIECE, i).alias(f"x{i}") for i in range(BLOCK + WINDOW - 1)])
    width = 1
    while width < WINDOW:
        many = BLOCK + WINDOW - 4 * width
        blocks = blocks.select(*held, "first", "windows", "one", *[F.least(*[f"x{i + j * width}" for j in range(4)]).alias(f"x{i}") for i in range(many)])
        width *= 4
    grams = F.array_distinct(F.coalesce("one", F.slice(F.array(*[F.col(f"x{i}") - F.col("first") for i in range(BLOCK)]), F.lit(1), F.col("windows"))))
    return blocks.select(*held, grams.alias("grams")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "block", "grams"))).alias("grams"))


def _of(*parts: int) -> Column:
    """The chosen k-grams of these parts together, from the column grams of `chosen`."""
    return F.array_distinct(F.flatten(F.transform(F.filter("grams", lambda x: x.part.isin(*parts) & x.grams.isNotNull()), lambda x: x.grams)))


def _part(part: int, text: Column, whole: Column, shift: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), whole.alias("whole"), shift.alias("shift"), text.alias("text"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: the chosen k-grams of text in order, each hash x 2**31 - position."""
    held = whole_rows(df).withColumn("nth", F.monotonically_increasing_id())
    parts = F.array(_part(0, F.coalesce(F.col("row").getField(text), F.lit("")), F.lit(True), F.lit(0)))
    grams = chosen(held, ["nth"], parts)
    return held.join(grams, "nth").select("row.*", _of(0).alias(name))


def hashes(name: str) -> Column:
    """The hashes of a fingerprint column, in order."""
    return F.transform(name, lambda p: F.shiftrightunsigned(p + F.lit(POSITIONS - 1), 31))


def positions(name: str) -> Column:
    """The first code point of each chosen k-gram."""
    return F.transform(name, lambda p: (F.shiftleft(F.shiftrightunsigned(p + F.lit(POSITIONS - 1), 31), 31) - p).cast("int"))


def likeness(a: str, b: str) -> Column:
    """Of two stored columns of hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def printed(name: str) -> Column:
    return F.array_join(F.transform(name, lambda h: F.lower(F.hex(h))), " ")


def _place(heads: list[int], of: Column) -> Column:
    """How many of the descending heads are at least `of`, less one: looked up in blocks, then in one of them."""
    size = max(1, round(len(heads) ** 0.5))
    blocks = [heads[k : k + size] for k in range(0, len(heads), size)]

    def array(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    coarse = F.greatest(F.size(F.filter(array([b[0] for b in blocks]), lambda h: h >= of)), F.lit(1))
    block = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), coarse), ",").cast("array<bigint>")
    return (coarse - 1) * size + F.size(F.filter(block, lambda h: h >= of)) - 1


def beside_next(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, ..., own): every row once, and the first rows of each id range once more (own: false) in the range
    before it, so that a window over `range` ordered by descending doc_id sees every row's successor.

    Ranges are cut at quantiles of doc_id, eight for each shuffle partition, so that partitions hold about equally much.
    """
    ranges = ranges or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cut = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges + 1)], 20 * ranges).alias("q"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    heads = sorted(set(cut["q"] or []), reverse=True)  # greatest id of each range; nulls are the last range
    n = len(heads)
    own = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(_place(heads, F.col("doc_id")) if heads else F.lit(0))
    body = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), own.cast("int").alias("range"))
    last = n if cut["nulls"] else max(n - 1, 0)
    # the rows of a range's greatest id are the ones that the range before it needs to see
    head = F.element_at(F.split(F.lit(",".join(map(str, [*heads, 0]))), ",").cast("array<bigint>"), F.col("range") + 1)
    first = F.when(F.col("doc_id").isNull(), F.lit(cut["nulls"] > 0)).otherwise(F.col("doc_id") == head)
    before = F.when(F.col("range") == 0, F.lit(last + 1)).otherwise(F.col("range")) - 1
    places = F.when(first, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("turn")), F.struct(before.cast("int").alias("range"), F.when(F.col("range") == 0, 2).otherwise(1).alias("turn")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("turn")))
    )
    return body.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.range", "p.turn")


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and that of its edited text (hashes in hex), the positions of their k-grams
    (first code points), and the likenesses. The windows that lie in the half kept by the edit are made once for both."""
    # turn 1 and 2: rows of the next range, seen last; a range of one id only has no other order to rely on
    order = Window.partitionBy("range").orderBy("turn", F.desc_nulls_last("doc_id"), "text")
    rows = beside_next(docs).withColumn("next", F.lead("text").over(order)).withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("own", F.col("n_chars").cast("int") - F.col("half")).withColumn("same", F.greatest(F.col("own") - REACH, F.lit(0)))
    rows = rows.withColumn("head", F.substring("text", F.lit(1), F.col("own"))).withColumn("end", F.substring(F.coalesce("next", F.lit("")), F.lit(1), F.col("half")))
    sha = F.sha2(F.concat("head", "end").cast("binary"), 256)
    new, alone = F.col("same") == 0, F.lit(False)
    rest = F.col("same") + 1
    parts = F.array(
        _part(0, F.when(new, F.lit("")).otherwise(F.col("head")), alone, F.lit(0)),
        _part(1, F.substring("text", rest, F.col("n_chars").cast("int")), new, F.col("same")),
        _part(2, F.concat(F.substring("head", rest, F.col("own")), F.col("end")), new, F.col("same")),
    )
    keys = ["range", "nth", "turn", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys[:-1], sha.alias("edited_sha256"), parts.alias("parts"))
    rows = chosen(rows, keys, F.col("parts")).select(*keys, _of(0, 1).alias("own"), _of(0, 2).alias("edited"))
    rows = rows.select("*", hashes("own").alias("f"), hashes("edited").alias("e"))
    rows = rows.withColumn("f_next", F.lead("f").over(Window.partitionBy("range").orderBy("nth"))).where("turn = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed("f").alias("fingerprint"),
        printed("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"),
        likeness("f", "f_next").alias("near_next"),
        positions("own").alias("positions"),
        positions("edited").alias("edited_positions"),
    )
