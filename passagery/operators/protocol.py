"""Splits, folds, configuration grids, selection rules and set checks."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 1729


class FrozenSplitError(ValueError):
    """A stored split doesn't fit its source."""


class Unavailable(RuntimeError):
    """A model or service that a configuration asks for isn't there."""


class InvalidChunkMapping(ValueError):
    """Labels name chunks that the corpus lacks."""


def seeded(key: Column, seed: int = SEED) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def allocate(counts: DataFrame, target: int, name: str = "category", size: str = "n") -> DataFrame:
    """(name, size, quota): target split in proportion to the sizes by largest remainders, ties to the later name."""
    total = counts.agg(F.sum(size).alias("total"))
    exact = counts.crossJoin(total).withColumn("exact", F.lit(float(target)) * F.col(size) / F.col("total"))  # one row
    exact = exact.withColumn("quota", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.floor("exact"), 9))
    left = exact.agg((F.lit(target) - F.sum("quota")).alias("left"))
    w = Window.orderBy(F.col("rest").desc(), F.col(name).desc())  # one row per category
    return exact.crossJoin(left).withColumn("place", F.row_number().over(w)).select(
        name, size, (F.col("quota") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota")
    )


def stratified_split(cases: DataFrame, key: str, category: str, first_size: int, names: tuple[str, str] = ("dev", "test"), seed: int = SEED) -> DataFrame:
    """cases with split: exactly first_size of them in the first split, in proportion by category, picked by hash."""
    sizes = cases.groupBy(category).agg(F.count("*").alias("n"))
    quota = allocate(sizes, first_size, category)
    w = Window.partitionBy(category).orderBy(seeded(F.col(key), seed), key)
    placed = cases.withColumn("_n", F.row_number().over(w)).join(quota.select(category, "quota"), category)
    return placed.withColumn("split", F.when(F.col("_n") <= F.col("quota"), names[0]).otherwise(names[1])).drop("_n", "quota")


def exact_split(ids: dict[str, list[str]], quotas: dict[str, int], seed: int = SEED) -> tuple[list[str], list[str]]:
    """The driver-side split with Python's generator: each sorted category is shuffled in turn, its first ids go to dev."""
    rng = random.Random(seed)
    dev: set[str] = set()
    for category in sorted(ids):
        own = list(ids[category])
        rng.shuffle(own)
        dev.update(own[: quotas[category]])
    every = [i for own in ids.values() for i in own]
    return [i for i in every if i in dev], [i for i in every if i not in dev]


def grouped_folds(rows: DataFrame, group: str, folds: int, seed: int = SEED) -> DataFrame:
    """rows with fold: rows of one group share a fold, and folds differ by at most one group.

    Groups are numbered in hash order by counting the ranges of a first-byte histogram, so no window
    runs over all groups.
    """
    if folds < 2:
        raise ValueError("at least 2 folds are needed")
    groups = rows.select(group).distinct().withColumn("_h", seeded(F.col(group), seed))
    groups = groups.withColumn("_c", F.substring("_h", 1, 3))
    cells = groups.groupBy("_c").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4096 rows
    inside = F.row_number().over(Window.partitionBy("_c").orderBy("_h", group)) - 1
    numbered = groups.withColumn("_i", inside).join(cells.select("_c", before.alias("_b")), "_c")
    return rows.join(numbered.select(group, F.pmod(F.col("_b") + F.col("_i"), F.lit(folds)).cast("int").alias("fold")), group)


def check_labels(labels: DataFrame, corpus: DataFrame, key: str) -> None:
    """Raise InvalidChunkMapping if labels name keys that the corpus lacks."""
    missing = labels.select(key).distinct().join(corpus.select(key), key, "left_anti")
    some = [r[0] for r in missing.limit(5).collect()]
    if some:
        raise InvalidChunkMapping(f"labels without chunks, among them {some}")


def check_split(source: DataFrame, parts: dict[str, DataFrame], key: str) -> None:
    """Raise FrozenSplitError unless the parts are disjoint and together hold exactly the source's keys."""
    union = None
    for name, part in parts.items():
        own = part.select(key, F.lit(name).alias("part"))
        union = own if union is None else union.unionByName(own)
    if not union.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise FrozenSplitError("a case stands in two splits")
    keys = union.select(key)
    if not keys.exceptAll(source.select(key)).isEmpty() or not source.select(key).exceptAll(keys).isEmpty():
        raise FrozenSplitError("the splits don't hold exactly the source's cases")


def observed_cases(*sets: DataFrame, key: str = "id") -> DataFrame:
    """All case sets together; an id that comes twice is an error."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if not out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a case id comes twice")
    return out


def spans_of_labels(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case, label, doc, start, end, gain): chunk labels turned into source intervals; ids compared in lower case."""
    c = chunks.select(F.lower("chunk_id").alias("label"), F.col("file_name").alias("doc"), F.col("source_char_start").alias("start"), F.col("source_char_end").alias("end"))
    own = labels.withColumn("label", F.lower("label"))
    check_labels(own, c, "label")
    return own.join(c, "label").select("case", "label", "doc", "start", "end", "gain")


def grid(spark: SparkSession, most: int = 48, **values: list) -> DataFrame:
    """One row per combination of the values, numbered (a bounded literal relation); more than `most` are an error."""
    names = list(values)
    rows = [(n, *combo) for n, combo in enumerate(product(*values.values()))]
    if len(rows) > most:
        raise ValueError(f"{len(rows)} combinations, at most {most} are allowed")
    return spark.createDataFrame(rows, ["config_no", *names])


def composite(keyword: Column, mrr: Column, recall: Column) -> Column:
    return F.round(0.6 * keyword + 0.25 * mrr + 0.15 * recall, 4)


def rank_results(results: DataFrame) -> DataFrame:
    """Finished configurations in order: nDCG, MRR, recall, precision, then the quicker."""
    w = Window.orderBy(F.desc("ndcg"), F.desc("mrr"), F.desc("recall"), F.desc("precision"), F.asc("elapsed"), "name")  # one row per configuration
    return results.where("status = 'ok'").withColumn("place", F.row_number().over(w))


def select_simplest(results: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The least complex configuration within tolerance of the best nDCG; then greater MRR, then name."""
    best = results.agg(F.max("ndcg").alias("best"))
    close = results.crossJoin(best).where(F.col("ndcg") >= F.col("best") * (1 - tolerance))  # one row
    return close.drop("best").orderBy("complexity", F.desc("mrr"), "name").limit(1)


def relative_improvement(new: Column, base: Column) -> Column:
    """Percent by which new exceeds base; null where base is 0 or missing."""
    return F.round(F.try_divide((new - base) * 100, base), 4)


def fingerprint(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


def numbered(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """df, one row a key, with n from 0 without gaps in hash order; no window runs over all rows."""
    own = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_c", F.substring("_h", 1, 3))
    cells = own.groupBy("_c").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4096 rows
    inside = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key)) - 1
    placed = own.withColumn("_i", inside).join(cells.select("_c", before.alias("_b")), "_c")
    return placed.withColumn("n", (F.col("_b") + F.col("_i")).cast("long")).drop("_h", "_c", "_i", "_b")


def check_contents(labels: DataFrame, corpus: DataFrame, key: str, content: str) -> None:
    """check_labels, and labels that carry the text of their chunk must carry the corpus's."""
    check_labels(labels, corpus, key)
    own = labels.select(key, F.col(content).alias("_own")).where("_own IS NOT NULL")
    some = [r[0] for r in own.join(corpus.select(key, content), key).where(~F.col("_own").eqNullSafe(F.col(content))).select(key).distinct().limit(5).collect()]
    if some:
        raise InvalidChunkMapping(f"labels whose text isn't the chunk's, among them {some}")


def freeze_split(cases: DataFrame, folder: str, key: str, category: str, first_size: int, seed: int = SEED) -> dict[str, DataFrame]:
    """The dev and test parts of a split that is made once: written on the first call, read and checked on later ones.

    The manifest keeps the seed, the sizes and a hash of the source's rows; a changed source, other
    sizes, doubled, lost or changed cases raise FrozenSplitError.
    """
    spark = cases.sparkSession
    rows = cases.withColumn("_row", F.sha2(F.to_json(F.struct(*sorted(cases.columns))), 256))
    source = rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256), F.count("*")).first()  # cases of one benchmark
    names = ("dev", "test")
    try:
        kept = spark.read.json(f"{folder}/manifest").first()
    except Exception as e:  # noqa: BLE001  (no such path)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    if kept is None:
        split = stratified_split(cases, key, category, first_size, names, seed)
        for n in names:
            split.where(F.col("split") == n).drop("split").write.parquet(f"{folder}/{n}")
        made = [(source[0], int(source[1]), seed, first_size)]
        spark.createDataFrame(made, "source_hash string, cases long, seed long, first_size long").coalesce(1).write.json(f"{folder}/manifest")
    elif (kept["source_hash"], kept["cases"], kept["seed"], kept["first_size"]) != (source[0], source[1], seed, first_size):
        raise FrozenSplitError("the stored split was made of other cases, or with another seed or size")
    parts = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    check_split(cases, parts, key)
    if parts["dev"].count() != first_size:
        raise FrozenSplitError("a stored part has another size")
    union = parts["dev"].unionByName(parts["test"]).select(*cases.columns)
    if not union.exceptAll(cases).isEmpty():
        raise FrozenSplitError("a stored case was changed")
    return parts


def strided(n: int, count: int, offset: int, step: int = 7) -> list[int]:
    """count places of n in strides from offset, around the end."""
    if n < 1:
        raise ValueError("nothing to pick from")
    return [(offset + step * i) % n for i in range(count)]


def adjacent_pairs(sections: DataFrame, doc: str, start: str, label: str) -> DataFrame:
    """(doc, first, second): the sections of each document in pairs that don't overlap; an odd last one is left out."""
    w = Window.partitionBy(doc).orderBy(start, label)  # one document's sections
    own = sections.withColumn("_n", F.row_number().over(w)).withColumn("second", F.lead(label).over(w))
    return own.where("_n % 2 = 1 AND second IS NOT NULL").select(doc, F.col(label).alias("first"), "second")


def build_cases(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """(case, question, category, labels): targets (case, question, category, span_id, gain) joined with their spans.

    A target without a span raises InvalidChunkMapping; labels are in the order of their gains, the greatest first.
    """
    s = spans.select("span_id", "document_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    check_labels(targets, s, "span_id")
    one = F.struct((-F.col("gain")).alias("order"), "span_id", "document_id", "start", "end", "gain")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["span_id"].alias("span_id"), x["document_id"].alias("document_id"), x["start"].alias("start"), x["end"].alias("end"), x["gain"].alias("gain")))
    return targets.join(s, "span_id").groupBy("case", "question", "category").agg(listed.alias("labels"))  # one case's labels


def case_faults(cases: DataFrame, spans: DataFrame, per_category: int | None = None) -> DataFrame:
    """(fault, name): doubled ids and questions, categories out of balance, cases without labels, labels without a span; none if all is well."""
    many = lambda c, fault: cases.groupBy(c.alias("name")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(fault).alias("fault"), F.col("name").cast("string").alias("name"))
    out = many(F.col("case"), "doubled id").unionByName(many(F.lower(F.trim(F.regexp_replace("question", r"\s+", " "))), "doubled question"))
    if per_category is not None:
        uneven = cases.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") != per_category)
        out = out.unionByName(uneven.select(F.lit("uneven category").alias("fault"), F.col("name").cast("string").alias("name")))
    bare = cases.where(F.coalesce(F.size("labels"), F.lit(0)) < 1).select(F.lit("no label").alias("fault"), F.col("case").cast("string").alias("name"))
    named = cases.select(F.explode("labels.span_id").alias("span_id"))
    lost = named.join(spans.select("span_id"), "span_id", "left_anti").distinct().select(F.lit("unknown span").alias("fault"), F.col("span_id").alias("name"))
    return out.unionByName(bare).unionByName(lost)


def catalog_hash(spans: DataFrame) -> str:
    """A hash of the span catalog: document, span, place and heading of each, in order of document and place."""
    line = F.concat_ws("\t", "document_id", "span_id", F.col("span_start").cast("string"), F.col("span_end").cast("string"), "heading")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("document_id", "span_start", "span_id", line.alias("line")))), lambda s: s["line"])
    return spans.agg(F.sha2(F.array_join(listed, "\n"), 256)).first()[0]  # spans of one benchmark's corpus


#: What can become of a configuration.
STATUSES = ("ok", "invalid_label_mapping", "unavailable", "blocked", "error")


def run_specs(specs: dict[str, dict], run: Callable[[dict], dict[str, float]], blocked: Callable[[dict], str | None] = lambda spec: None) -> list[dict]:
    """One record a configuration: name, status, error, seconds, the settings and the metrics of run(settings).

    A failing configuration is recorded and doesn't end the others. blocked may give a reason not to run one.
    """
    out = []
    for name, spec in specs.items():
        began = time.perf_counter()
        status, error, metrics = "ok", "", {}
        if reason := blocked(spec):
            status, error = "blocked", reason
        else:
            try:
                metrics = run(spec)
                if not metrics:
                    status, error = "error", "no metrics"
            except InvalidChunkMapping as e:
                status, error = "invalid_label_mapping", str(e)
            except Unavailable as e:
                status, error = "unavailable", str(e)
            except Exception as e:  # noqa: BLE001  (recorded)
                status, error = "error", f"{type(e).__name__}: {e}"
        out.append({"name": name, "status": status, "error": error, "elapsed": round(time.perf_counter() - began, 4), **{f"spec_{k}": v for k, v in spec.items()}, **metrics})
    return out


def unique_specs(specs: list[tuple[str, dict]]) -> dict[str, dict]:
    """The configurations without repetitions of both name and settings, in their order; one name for two settings is an error."""
    out: dict[str, dict] = {}
    for name, spec in specs:
        if out.setdefault(name, spec) != spec:
            raise ValueError(f"two configurations are named {name}")
    return out


def select_best(results: list[dict], latency: str = "latency_ms") -> dict:
    """The finished configuration of the greatest nDCG, then MRR, then recall, then the least latency."""
    ok = [r for r in results if r["status"] == "ok"]
    if not ok:
        raise ValueError("no configuration finished")
    return max(ok, key=lambda r: (r["ndcg"], r["mrr"], r["recall"], -r.get(latency, 0.0)))


def ranker_helps(base: dict[str, float], ranked: dict[str, float]) -> bool:
    """A learned order is used only where it raises nDCG and doesn't lower MRR."""
    return ranked["ndcg"] > base["ndcg"] and ranked["mrr"] >= base["mrr"]


def dev_then_test(specs: dict[str, dict], dev: Callable[[dict], dict[str, float]], test: Callable[[dict], dict[str, float]], baseline: str) -> dict:
    """The whole protocol: all configurations on DEV, the best one chosen there, and only it and the baseline on TEST, once each."""
    on_dev = run_specs(specs, dev)
    best = select_best(on_dev)["name"]
    on_test = run_specs({n: specs[n] for n in dict.fromkeys((baseline, best))}, test)
    return {"dev": on_dev, "selected": best, "test": on_test}
