"""Problem 5: train / validation / test splits that keep linked records together.

Records and the entities they name form a bipartite graph. Labels start as record numbers; in each
round every entity takes the least label of its records, every record the least label of its
entities. All records of one label then take the least label that any of them met, and the label that
one takes in its turn (so long chains shorten by halves). When nothing changes, the label is the group.
Rounds are cut from each other by files in the shared folder, which the next round deletes. Minima are
combined before each shuffle, so a hot entity sends one row per task; what belongs to a hot entity or
group comes back by broadcast or salted joins, so its records are never in one task.

Groups are then assigned so that each split comes close to its share of every stratum. Large groups
are placed one by one; the many small ones are bundled by hash into a fixed number of cells, so what
the driver sees doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagery.llm.skew import HOT_ROWS, hot_above, small_or_salted_join, split_join
from passagery.runtime import cut_lineage, drop_files, on_files

#: What stands for "no value" in any case.
PLACEHOLDERS = ("", "-", "n/a", "unknown")


SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def tidy(c: Column) -> Column:
    """Lower case without outer blanks; placeholders become null."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(~t.isin(*PLACEHOLDERS), t)


def tidy_path(c: Column) -> Column:
    return tidy(F.replace(c, F.lit("\\"), F.lit("/")))


def links(cases: DataFrame, labels: DataFrame, spans: DataFrame) -> DataFrame:
    """(r, kind, entity): which case names which author, entity or labelled document."""
    r = F.col("case_no").cast("long").alias("r")
    named = cases.where("case_no IS NOT NULL")
    authors = named.select(r, F.lit("a").alias("kind"), tidy(F.col("author")).alias("entity"))
    entities = named.select(r, F.lit("e").alias("kind"), F.explode("entities").alias("entity")).select(
        "r", "kind", tidy(F.col("entity")).alias("entity")
    )
    known = spans.where("span_id IS NOT NULL").groupBy(F.col("span_id").alias("label_id")).agg(
        F.min(tidy_path(F.col("document_id"))).alias("span_document")
    )
    own = labels.where("case_no IS NOT NULL").select(r, "label_id", tidy_path(F.col("document_id")).alias("own"))
    direct = own.where("own IS NOT NULL").select("r", F.lit("d").alias("kind"), F.col("own").alias("entity"))
    named_only = own.where("own IS NULL AND label_id IS NOT NULL")
    asked = named_only.groupBy("label_id").agg(F.count("*").alias("held"))
    lookup = split_join(named_only, asked.join(known, "label_id"), ["label_id"], "held", hot_above(labels.count())).select(
        "r", F.lit("d").alias("kind"), F.col("span_document").alias("entity")
    )
    return authors.unionByName(entities).unionByName(direct).unionByName(lookup).where("entity IS NOT NULL").distinct()


def components(link: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(r, g): every linked record with the least record number of its group.

    Entities that only one record names are dropped, since they link nothing. An entity is known by
    the least record that names it: two entities with the same least record share that record and
    so belong to one group anyway, which makes the edges fewer. Labels only fall, so the rounds end.
    """
    spark = link.sparkSession
    link, link_files = on_files(link, "link")
    above = hot_above(link.count(), hot_rows)
    least = link.groupBy("kind", "entity").agg(F.min("r").alias("e"), F.max("r").alias("last"), F.count("*").alias("held")).where("e < last").drop("last")
    edges = split_join(link, least, ["kind", "entity"], "held", above)
    # one row a record, with its entities
    state, files = on_files(edges.groupBy("r").agg(F.collect_set("e").alias("es")).select("r", F.least("r", F.array_min("es")).alias("g"), "es"), "labels")
    drop_files(spark, link_files)
    hot = [r["e"] for r in state.select(F.explode("es").alias("e")).groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") > above).collect()]  # few
    hot = spark.createDataFrame([(e,) for e in hot], "e long") if hot else None
    labels = state
    while True:
        long = labels.select("r", "g", F.explode("es").alias("e"))
        by_entity = long.groupBy("e").agg(F.min("g").alias("m"))
        if hot is None:
            met = long.join(by_entity, "e")
        else:
            met = long.join(F.broadcast(by_entity.join(F.broadcast(hot), "e")), "e").unionByName(long.join(F.broadcast(hot), "e", "left_anti").join(by_entity, "e"))
        before = files
        state, files = on_files(met.groupBy("r").agg(F.min("g").alias("old"), F.min("m").alias("g"), F.collect_list("e").alias("es")), "labels")
        drop_files(spark, before)
        # labels of which a record met a lower one
        moved = cut_lineage(state.where("g < old").groupBy(F.col("old").alias("n")).agg(F.min("g").alias("h")))
        if moved.isEmpty():
            placed = cut_lineage(state.select("r", "g"))
            drop_files(spark, files)
            return placed
        further = moved.select(F.col("n").alias("h"), F.col("h").alias("h2"))
        heads = moved.join(further, "h", "left").select("n", F.coalesce("h2", "h").alias("h"))
        named = state.select("r", F.col("old").alias("n"), "es")
        labels = small_or_salted_join(named, heads, ["n"], F.col("r"), "left").select("r", F.coalesce("h", "n").alias("g"), "es")


def grouped(records: DataFrame, link: DataFrame) -> DataFrame:
    """records (with a column r) and their group g; a record without links is its own group."""
    return records.join(components(link), "r", "left").withColumn("g", F.coalesce("g", "r"))


def divided_cases(cases: DataFrame, labels: DataFrame, spans: DataFrame) -> DataFrame:
    """(case_no): cases whose group stands in two or more of the present splits.

    Null case numbers are left out; a null split counts as none; rows loaded twice change nothing;
    labels of cases that don't exist link nothing by themselves but join what they share.
    """
    rows = cases.where("case_no IS NOT NULL").select(
        F.col("case_no").cast("long").alias("r"), F.lower(F.trim("split_name")).alias("s")
    ).distinct()
    placed = cut_lineage(grouped(rows, links(cases, labels, spans)))
    split = placed.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("g", "held")
    return split_join(placed, split, ["g"], "held", hot_above(placed.count())).select(F.col("r").alias("case_no")).distinct()


def assign_units(counts: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """For each unit (row of counts by stratum) the split that keeps the deviation from the targets least.

    Units go from large to small; each to the split where it lowers the sum of squared shortfalls most.
    """
    targets = np.outer(np.array(shares) / sum(shares), counts.sum(axis=0)).astype(float)
    have = np.zeros_like(targets)
    out = np.zeros(len(counts), int)
    weight = 1.0 / np.maximum(counts.sum(axis=0), 1)
    totals = targets.sum(axis=1)
    for u in np.argsort(-counts.sum(axis=1), kind="stable"):
        x = counts[u]
        cost = ((2 * (have - targets) * x + x * x) * weight).sum(axis=1)
        whole = (2 * (have.sum(axis=1) - totals) + x.sum()) * x.sum() / max(counts.sum(), 1)
        k = int(np.argmin(cost + whole))
        out[u] = k
        have[k] += x
    return out


def new_splits(
    cases: DataFrame,
    labels: DataFrame,
    spans: DataFrame,
    shares: Mapping[str, float] | None = None,
    cells: int = 2048,
    least_stratum: float = 0.001,
) -> DataFrame:
    """(case_no, group_no, new_split): every case with its group and its split.

    Strata are the values of category; those under least_stratum of all cases are taken together,
    which bounds their number. Groups of at least 1/cells of all cases are placed singly, of which
    there are at most cells; the rest in cells by hash. A group larger than a split's share makes
    that split too large; split_report shows it.
    """
    shares = shares or SHARES
    rows = cases.where("case_no IS NOT NULL").groupBy(F.col("case_no").cast("long").alias("r")).agg(
        F.min(F.coalesce(F.col("category"), F.lit("none"))).alias("category")
    )
    placed = cut_lineage(grouped(rows, links(cases, labels, spans)))
    total = placed.count()
    common = placed.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= least_stratum * total)
    strata = placed.join(F.broadcast(common.select("category", F.col("category").alias("stratum"))), "category", "left").withColumn(
        "stratum", F.coalesce("stratum", F.lit("other"))
    )
    sizes = placed.groupBy("g").agg(F.count("*").alias("size"))
    unit = F.when(F.col("size") >= total / cells, F.concat(F.lit("g"), F.col("g"))).otherwise(
        F.concat(F.lit("c"), F.pmod(F.xxhash64("g"), F.lit(cells)))
    )
    units = sizes.select("g", unit.alias("unit"))
    per = strata.groupBy("g", "stratum").agg(F.count("*").alias("n")).join(units, "g").groupBy("unit", "stratum").agg(F.sum("n").alias("n"))
    found = per.collect()  # at most 2 * cells units by 1 / least_stratum strata
    names = sorted({r["unit"] for r in found})
    kinds = sorted({r["stratum"] for r in found})
    counts = np.zeros((len(names), len(kinds)))
    at, col = {n: i for i, n in enumerate(names)}, {k: i for i, k in enumerate(kinds)}
    for r in found:
        counts[at[r["unit"]], col[r["stratum"]]] = r["n"]
    split_names = list(shares)
    chosen = assign_units(counts, list(shares.values()))
    plan = cases.sparkSession.createDataFrame(
        [(n, split_names[k]) for n, k in zip(names, chosen)], "unit string, new_split string"
    )
    return (
        small_or_salted_join(placed, units, ["g"], F.col("r"))
        .join(F.broadcast(plan), "unit")
        .select(F.col("r").alias("case_no"), F.col("g").alias("group_no"), "new_split")
    )


def split_report(splits: DataFrame, cases: DataFrame, shares: Mapping[str, float] | None = None) -> DataFrame:
    """(new_split, cases, groups, share, target_share, label_deviation): one row a split, also for one that got no case.

    label_deviation is the sum, over the values of category, of how far their share in the split is from
    their share in all cases; a split without cases has none. A null category is a value of its own.
    """
    shares = shares or SHARES
    whole = sum(shares.values())
    label = cases.where("case_no IS NOT NULL").groupBy(F.col("case_no").cast("long").alias("case_no")).agg(
        F.min(F.coalesce(F.col("category"), F.lit("none"))).alias("category")
    )
    by = splits.join(label, "case_no").groupBy("new_split", "category").agg(F.count("*").alias("n"))
    total = by.groupBy("category").agg(F.sum("n").alias("all_n"))
    sizes = splits.groupBy("new_split").agg(F.count("*").alias("cases"), F.count_distinct("group_no").alias("groups"))
    every = sizes.agg(F.sum("cases").alias("every"))  # one row
    cell = sizes.select("new_split", "cases").crossJoin(total).crossJoin(every).join(by, ["new_split", "category"], "left")  # splits by categories
    off = cell.groupBy("new_split").agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("cases") - F.col("all_n") / F.col("every"))).alias("label_deviation"))
    names = splits.sparkSession.createDataFrame([(k, v / whole) for k, v in shares.items()], "new_split string, target_share double")
    out = names.join(sizes, "new_split", "left").join(off, "new_split", "left").crossJoin(every)
    return out.select(
        "new_split", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("groups", F.lit(0)).alias("groups"),
        F.round(F.coalesce(F.col("cases") / F.col("every"), F.lit(0.0)), 6).alias("share"), "target_share", F.round("label_deviation", 6).alias("label_deviation"),
    )
