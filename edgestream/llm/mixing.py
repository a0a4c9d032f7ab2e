"""Operator 3, mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source's documents all want target / source_size copies. The whole part of that is given; the
fractional parts are rounded dependently: of two documents with fractional masses (share times words),
one hands mass to the other, by a draw that keeps every expected share, until one of them is whole. So
the words that a source gets stay exactly on target, up to one last document.

The rounding is a reduction tree: documents fall by hash into blocks of about BLOCK of their source, a
block folds its documents in order and leaves one fractional residual, and blocks of residuals fold in
turn until a source has one, which a last draw settles. Equal rows are counted first and are one item of the
tree, so no task sees more than a block at once, however large a source is, and only the small rows of (document, size) are exchanged, never texts. The draws are
hashes of the documents' keys, so reruns agree, whatever the layout of the input.

Defined results: a null text has size 0; a document of size 0 takes 0 words, and a source of size 0 has
the target 0; a null source is a source of its own, the last in order; repeated rows are documents of
their own; an empty table gives an empty result; extra columns are not read (mix() returns them all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BLOCK = 512
#: Least sizes of the strata, from the largest documents down.
STRATA = (1024, 256, 128, 64, 16, 1)
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"

_ITEM = "struct<h:bigint,rid:bigint,doc_id:{},size:bigint,mass:double>"
_DONE = "array<struct<rid:bigint,doc_id:{},size:bigint,up:int>>"


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """rid, doc_id, source, size, h: a small written table; h names a document by its content."""
    text = F.col("text").cast("string")
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", source, text).alias("h"),
    )
    return materialise(found, "sized")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n (documents with words), weight, target: one row a source.

    Resharing an excess by weight until no target exceeds its bound ends at the level L with
    target = min(bound, L * weight): sources are met in the order of bound / weight, and the first one
    whose bound lies above the level left for it fixes L. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    bounded = per.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("double"))
    by_need = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size")).over(Window.partitionBy()) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    share = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = bounded.withColumn("level", left / share).withColumn("free", F.col("level") * F.col("weight") < F.col("bound"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.coalesce(F.least("bound", level * F.col("weight")), F.col("bound"))
    return leveled.withColumn("target", target).select("source", "source_size", "n", "weight", "target")


def _draw(*keys: Column) -> Column:
    """A uniform number in [0, 1) of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), *keys), 11) / F.lit(float(1 << 53))


def _fold(items: Column, id_type: str) -> Column:
    """Fold a block's items: struct of the carry (h null if there is none) and the settled documents."""
    item, done = _ITEM.format(id_type), _DONE.format(id_type)
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(done).alias("done"))

    def settle(x: Column, up: int) -> Column:
        return F.struct(x["rid"].alias("rid"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.lit(up).alias("up"))

    def hold(x: Column, mass: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["rid"].alias("rid"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), mass.alias("mass"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        room_c, room_x = c["size"] - c["mass"], x["size"] - x["mass"]
        to_c, to_x = F.least(room_c, x["mass"]), F.least(c["mass"], room_x)
        inward = _draw(c["h"], x["h"], c["rid"] == x["rid"]) * (to_c + to_x) < to_x

        def after(kept: Column, settled: Column) -> Column:
            return F.struct(kept.alias("carry"), F.array_append(acc["done"], settled).alias("done"))

        return (
            F.when(c.isNull(), F.struct(hold(x, x["mass"]).alias("carry"), acc["done"].alias("done")))
            .when(inward & (room_c <= x["mass"]), after(hold(x, x["mass"] - room_c), settle(c, 1)))
            .when(inward, after(hold(c, c["mass"] + x["mass"]), settle(x, 0)))
            .when(room_x <= c["mass"], after(hold(c, c["mass"] - room_x), settle(x, 1)))
            .otherwise(after(hold(x, x["mass"] + c["mass"]), settle(c, 0)))
        )

    return F.aggregate(items, start, step)


def _level(items: DataFrame, id_type: str) -> DataFrame:
    """One level of the tree: a row (source, block, carry, done) for each block."""
    kind = f"array<{_ITEM.format(id_type)}>"
    grouped = items.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("h", "rid", "doc_id", "size", "mass"))).cast(kind).alias("items"))
    return materialise(grouped.select("source", "block", _fold(F.col("items"), id_type).alias("f")).select("source", "block", "f.carry", "f.done"), "level")


def _round(items: DataFrame, most_items: int, id_type: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Fold items up the tree. The settled rows (source, rid, doc_id, size, up), and each source's last residual with its draw."""
    now = _level(items, id_type)
    ups = now.select("source", F.inline("done"))
    count = -(-most_items // block)
    while count > 1:
        residuals = now.where("carry is not null").select("source", F.floor(F.col("block") / block).alias("block"), "carry.*")
        now = _level(residuals, id_type)
        ups = ups.unionAll(now.select("source", F.inline("done")))
        count = -(-count // block)
    up = (_draw(F.col("h")) * F.col("size") < F.col("mass")).cast("int")
    last = now.where("carry is not null").select("source", "carry.*").withColumn("up", up)
    return ups.unionAll(last.select("source", "rid", "doc_id", "size", "up")), last.select("source", (F.col("up") * F.col("size") - F.col("mass")).alias("error"))


def _settled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rid, copies of every row of sized(): a group of m equal rows shares its total of copies as evenly as can be.

    Which of the equal rows has one more is told by their rank: counts by partition (the upper bits of rid) are
    added up over the partitions, and ranks run within a partition, so no task sees a whole group.
    """
    single = groups.where("m = 1").select("rid", F.col("total").alias("copies"))
    many = groups.where("m > 1").select(F.col("source").alias("g_source"), F.col("doc_id").alias("g_doc"), "h", F.col("size").alias("g_size"), F.col("rid").alias("g"), "m", "total")
    same = F.col("source").eqNullSafe(F.col("g_source")) & F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("size") == F.col("g_size"))
    member = rows.join(many, "h").where(same).select("rid", "g", "m", "total", F.shiftrightunsigned("rid", 33).alias("part"))
    counts = member.groupBy("g", "part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = member.join(counts.select("g", "part", offset.alias("offset")), ["g", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("g", "part").orderBy("rid")) - 1)
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("rank") < F.col("total") % F.col("m")).cast("long")
    return single.unionAll(ranked.select("rid", copies.alias("copies")))


def mixed(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK, strata: Sequence[int] = STRATA) -> DataFrame:
    """rid, doc_id, size, source, source_size, target, copies, taken of every row of sized().

    Equal rows are one item: of m of them, with a share of s copies each, the whole part of m s is given and
    the rest is rounded. Strata of document sizes are rounded from the largest down. What a stratum's last draw
    misses by is taken out of the shares of the next one, which may so rise or fall by whole copies (from none
    to the bound). So a source ends within one of its smallest documents of its target, unless the smaller
    strata hold fewer words than a large document's draw missed by. A draw's expectation is zero.
    """
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    goal = materialise(targets(sizes, weights, most), "targets")
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    tops = [1 << 62, *strata[:-1]]
    inside = [(F.col("size") >= low) & (F.col("size") < top) for low, top in zip(strata, tops, strict=True)]
    groups = materialise(sizes.where(F.col("size") >= strata[-1]).groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("m"), F.min("rid").alias("rid")), "groups")
    words = [F.sum(F.when(c, F.col("size") * F.col("m"))).alias(f"w{k}") for k, c in enumerate(inside)]
    counts = [F.count_if(c).alias(f"n{k}") for k, c in enumerate(inside)]
    per = materialise(groups.groupBy("source").agg(*words, *counts), "strata")
    per = per.withColumnRenamed("source", "p_source")
    state = goal.join(per, goal.source.eqNullSafe(per.p_source)).drop("p_source").withColumn("share", share).withColumn("error", F.lit(0.0))
    most_items = state.agg(*(F.max(f"n{k}") for k in range(len(strata)))).first()
    ups: DataFrame | None = None
    used = [k for k in range(len(strata)) if most_items[k]]
    for k in used:
        s = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("share") - F.col("error") / F.col(f"w{k}")))
        state = materialise(state.withColumn(f"s{k}", F.when(F.col(f"w{k}") > 0, s)), "shares")
        named = state.select(F.col("source").alias("g_source"), F.col(f"s{k}").alias("s"), F.ceil(F.col(f"n{k}") / block).alias("blocks"))
        wanted = groups.where(inside[k]).join(named, groups.source.eqNullSafe(named.g_source))
        mass = (F.col("m") * F.col("s") - F.floor(F.col("m") * F.col("s"))) * F.col("size")
        items = wanted.select("source", F.pmod("h", "blocks").alias("block"), "h", "rid", "doc_id", "size", mass.alias("mass"))
        found, error = _round(items, most_items[k], id_type, block)
        ups = found if ups is None else ups.unionAll(found)
        left = F.col("error") - F.coalesce((F.col("share") - F.col(f"s{k}")) * F.col(f"w{k}"), F.lit(0.0))
        drawn = error.select(F.col("source").alias("e_source"), F.col("error").alias("drawn"))
        state = state.join(drawn, state.source.eqNullSafe(drawn.e_source), "left").withColumn("error", left + F.coalesce("drawn", F.lit(0.0))).drop("e_source", "drawn")
    named = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    if ups is None:
        copied = sizes.withColumn("copies", F.lit(0).cast("long"))
    else:
        of_size = F.lit(None).cast("double")
        for k in used:
            of_size = F.when(inside[k], F.col(f"s{k}")).otherwise(of_size)
        shares = state.select(F.col("source").alias("t_source"), *(f"s{k}" for k in used))
        whole = groups.join(shares, groups.source.eqNullSafe(shares.t_source)).withColumn("whole", F.floor(F.col("m") * of_size)).select(*groups.columns, "whole")
        totals = materialise(whole.join(ups.select("rid", "up"), "rid").select(*groups.columns, (F.col("whole") + F.col("up")).alias("total")), "totals")
        copied = sizes.join(_settled(sizes, totals), "rid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))
    out = copied.join(named, copied.source.eqNullSafe(named.g_source))
    return out.select("rid", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of every document."""
    return mixed(sized(docs, source), weights, most).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with all its columns."""
    numbered = materialise(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "numbered")
    text = F.col("row.text").cast("string")
    sizes = numbered.select(
        "rid",
        F.col("row.doc_id").alias("doc_id"),
        F.col(f"row.{source}").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), "row.doc_id", f"row.{source}", text).alias("h"),
    )
    taken = mixed(materialise(sizes, "sized"), weights, most).where("copies > 0").select("rid", "copies")
    repeated = numbered.join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("row.*")
