"""Sources and sinks: JSON lines, CSV and plain text in, a canonical table, versioned corpora with a manifest out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.names import shared_folder

CANONICAL = Ty.StructType(
    [
        *[Ty.StructField(c, Ty.StringType(), c not in ("sample_id", "text")) for c in ("sample_id", "text", "origin", "domain", "language", "source_dataset", "source_id", "generator", "humanizer", "transformation_severity", "parent_id")],
        *[Ty.StructField(c, Ty.IntegerType()) for c in ("word_count", "char_count", "sentence_count")],
        *[Ty.StructField(c, Ty.StringType()) for c in ("content_hash", "created_at", "split")],
        Ty.StructField("fold", Ty.IntegerType()),
        Ty.StructField("annotations", Ty.MapType(Ty.StringType(), Ty.StringType())),
    ]
)
#: One stretch of a text with its own origin.
SEGMENT = Ty.StructType([Ty.StructField("start", Ty.IntegerType()), Ty.StructField("end", Ty.IntegerType()), Ty.StructField("origin", Ty.StringType()), Ty.StructField("confidence", Ty.DoubleType())])


def canonical(rows: DataFrame) -> DataFrame:
    """Canonical columns from whatever of them rows has; counts, hash and time are filled where missing or 0."""
    have = {c.lower() for c in rows.columns}
    of = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    none = lambda t: F.lit(None).cast(t)
    count = lambda c, other: F.coalesce(F.when(F.col(c) != 0, F.col(c)), other) if c in have else other
    text = F.col("text")
    given = {
        "sample_id": F.col("sample_id").cast("string"),
        "text": text,
        "origin": of("origin", F.lit("HUMAN")),
        "domain": of("domain", F.lit("OTHER")),
        "language": of("language", F.lit("en")),
        "source_dataset": of("source_dataset", F.lit("")),
        "source_id": of("source_id", F.lit("")),
        "generator": of("generator", none("string")),
        "humanizer": of("humanizer", none("string")),
        "transformation_severity": of("transformation_severity", F.lit("NONE")),
        "parent_id": of("parent_id", none("string")),
        "word_count": count("word_count", T.n_space_words(text)),
        "char_count": count("char_count", F.length(text)),
        "sentence_count": count("sentence_count", F.lit(0)),
        "content_hash": of("content_hash", F.sha2(text, 256)),
        "created_at": of("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")),
        "split": of("split", none("string")),
        "fold": of("fold", none("int")),
        "annotations": of("annotations", F.create_map().cast("map<string,string>")),
    }
    return rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL])


def invalid(rows: DataFrame) -> DataFrame:
    """Rows whose origin, domain or severity is outside its domain."""
    bad = lambda c, domain: ~F.coalesce(F.col(c).isin(*domain), F.lit(False))
    return rows.filter(bad("origin", L.ORIGINS) | bad("domain", L.DOMAINS) | bad("transformation_severity", L.SEVERITIES))


def read_jsonl(spark: SparkSession, path: str, schema: Ty.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. A schema saves a pass over the file."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _ordinal(rows: DataFrame) -> DataFrame:
    """rows with `_row`, their place in the file from 0: offsets of partitions, not one sort of all rows.

    The numbered rows are stored, as adaptive plans would cut them into other partitions for their sizes than for the join.
    """
    shared_folder(rows.sparkSession)
    rows = rows.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()).checkpoint()
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_k").alias("_low"))
    sizes = sizes.select("_p", "_low", (F.sum("n").over(W.orderBy("_low")) - F.col("n")).alias("_before"))
    return rows.join(sizes, "_p").withColumn("_row", F.col("_before") + F.col("_k") - F.col("_low")).drop("_p", "_k", "_low", "_before")


def ingest_answers(rows: DataFrame) -> DataFrame:
    """Question and answer rows (human_answers, chatgpt_answers) as canonical rows, one per non-empty answer.

    Ids are hc3_human_{row}_{i} and hc3_ai_{row}_{i}, counted from 0.
    """
    rows = _ordinal(rows.select("human_answers", "chatgpt_answers"))
    kinds = (("human_answers", "human", "HUMAN", None), ("chatgpt_answers", "ai", "AI_RAW", "chatgpt"))
    out = None
    for column, tag, origin, generator in kinds:
        one = rows.select("_row", F.posexplode(F.col(column)).alias("i", "text")).filter(T.strip(F.col("text")) != "")
        one = one.select(F.concat_ws("_", F.lit("hc3"), F.lit(tag), "_row", "i").alias("sample_id"), "text", F.lit(origin).alias("origin"), F.lit("hc3").alias("source_dataset"), F.col("_row").cast("string").alias("source_id"), F.lit(generator).cast("string").alias("generator"))
        out = one if out is None else out.unionByName(one)
    return canonical(out)


def origin_of(label: Column, label_map: dict[str, str] | None = None) -> Column:
    """Origin by trimmed, lower-cased label; unknown labels are HUMAN."""
    known = label_map or L.LABEL_ORIGIN
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), F.lower(T.strip(label))), F.lit("HUMAN"))


def ingest_labelled(spark: SparkSession, path: str, text_field: str = "text", label_field: str = "label", source_name: str = "generic", label_map: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows of a labelled .jsonl or .csv file; the generator is column `generator`, else `model`."""
    if path.endswith((".jsonl", ".json")):
        rows = read_jsonl(spark, path)
    elif path.endswith(".csv"):
        rows = read_csv(spark, path)
    else:
        raise ValueError(f"unsupported file format: {path}")
    rows = _ordinal(rows).filter(F.coalesce(T.strip(F.col(text_field)), F.lit("")) != "")
    named = [F.col(c) for c in ("generator", "model") if c in rows.columns]
    label = F.coalesce(F.col(label_field).cast("string"), F.lit("human")) if label_field in rows.columns else F.lit("human")
    rows = rows.select(F.concat_ws("_", F.lit(source_name), "_row").alias("sample_id"), F.col(text_field).alias("text"), origin_of(label, label_map).alias("origin"), F.lit(source_name).alias("source_dataset"), F.col("_row").cast("string").alias("source_id"), (F.coalesce(*named) if named else F.lit(None).cast("string")).alias("generator"))
    return canonical(rows)


def _joined_hash(key: str, value: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)


def dataset_hash(rows: DataFrame, order: str = "sample_id") -> DataFrame:
    """(content_hash): sha256 of all content hashes in a fixed order, as a tree: ranges of 1 / 65536 of the keys' hashes, then 256 of
    them, then those. So no task gathers more than 1 / 65536 of the rows."""
    leaves = rows.select(F.col(order).alias("k"), "content_hash", F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 4).alias("r")).groupBy("r").agg(_joined_hash("k", "content_hash").alias("h"))
    nodes = leaves.groupBy(F.substring("r", 1, 2).alias("q")).agg(_joined_hash("r", "h").alias("h"))
    return nodes.agg(_joined_hash("q", "h").alias("content_hash"))


def plain_dataset_hash(rows: DataFrame, order: str = "sample_id") -> DataFrame:
    """(content_hash): sha256 of the concatenated content hashes in order, for tables of bounded size: one task holds them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content_hash"))), lambda x: x["content_hash"]), "")
    return rows.agg(F.sha2(joined, 256).alias("content_hash"))


def distributions(rows: DataFrame, columns: tuple[str, ...] = ("origin", "domain", "generator")) -> DataFrame:
    """(dimension, value, n): counts by each column in one pass of grouping sets."""
    counts = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g{k}") for k, c in enumerate(columns)])
    name = F.lit(None).cast("string")
    for k, c in enumerate(columns):
        name = F.when(F.col(f"g{k}") == 0, c).otherwise(name)
    return counts.select(name.alias("dimension"), F.coalesce(*[F.col(c) for c in columns]).alias("value"), "n").filter("value is not null")


#: Columns whose values a manifest counts, and what it calls the counts.
COUNTED = {"origin": "origin_distribution", "domain": "domain_distribution", "generator": "generator_distribution", "humanizer": "humanizer_distribution", "split": "split_sizes"}


def manifest(rows: DataFrame, name: str, version: str = "1.0", description: str = "", notes: str = "", plain_hash: bool = False) -> DataFrame:
    """One row about canonical rows: name, version, description, time, total, counts as maps, the dataset's hash, its sources and notes.

    The hash is a tree of hashes by sample_id, for tables of any size; with plain_hash, that of all content hashes joined in order
    of sample_id, for tables that one task can hold.
    """
    maps = [F.map_from_entries(F.coalesce(F.array_sort(F.collect_list(F.when(F.col("dimension") == c, F.struct("value", "n")))), F.array().cast("array<struct<value:string,n:bigint>>"))).alias(shown) for c, shown in COUNTED.items()]
    sources = F.array_sort(F.collect_list(F.when((F.col("dimension") == "source_dataset") & (F.col("value") != ""), F.col("value")))).alias("source_datasets")
    counts = distributions(rows, (*COUNTED, "source_dataset")).agg(*maps, sources)
    total = rows.agg(F.count("*").alias("total_samples"))
    parts = counts.crossJoin(total).crossJoin((plain_dataset_hash if plain_hash else dataset_hash)(rows))  # one row each
    said = [F.lit(x).alias(c) for c, x in (("name", name), ("version", version), ("description", description or f"Processed {name} dataset"))]
    return parts.select(*said, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "total_samples", *COUNTED.values(), "content_hash", "source_datasets", F.lit(notes).alias("notes"))


def save(rows: DataFrame, folder: str, name: str, version: str = "1.0", **about) -> str:
    """Writes folder/name/version/samples.jsonl and manifest.json (folders of JSON lines); returns their folder."""
    path = f"{folder}/{name}/{version}"
    rows.write.mode("overwrite").json(f"{path}/samples.jsonl")
    manifest(rows, name, version, **about).coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")
    return path


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CANONICAL)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_splits(rows: DataFrame, folder: str, name: str = "benchmark", dedup: DataFrame | None = None) -> None:
    """JSON lines partitioned by split, and dataset_manifest.json: name, totals in all and by split, dedup counts, origins and domains.

    dedup: one row (initial_count, exact_duplicates_removed, final_count), as dedup_report() gives it.
    """
    rows.write.mode("overwrite").partitionBy("split").json(f"{folder}/splits")
    split_manifest(rows, name, dedup).coalesce(1).write.mode("overwrite").json(f"{folder}/dataset_manifest.json")


def split_manifest(rows: DataFrame, name: str = "benchmark", dedup: DataFrame | None = None) -> DataFrame:
    """The row that save_splits() writes."""
    parts = [F.count_if(F.col("split") == x).alias(f"{x}_samples") for x in ("train", "val", "test")]
    total = rows.agg(F.count("*").alias("total_samples"), *parts)
    maps = [F.map_from_entries(F.coalesce(F.array_sort(F.collect_list(F.when(F.col("dimension") == c, F.struct("value", "n")))), F.array().cast("array<struct<value:string,n:bigint>>"))).alias(f"{c}s") for c in ("origin", "domain")]
    out = total.crossJoin(distributions(rows, ("origin", "domain")).agg(*maps))  # one row each
    if dedup is not None:
        out = out.crossJoin(dedup.select(F.struct("initial_count", "exact_duplicates_removed", "final_count").alias("dedup_metadata")))
    else:
        out = out.withColumn("dedup_metadata", F.lit(None).cast("struct<initial_count:bigint,exact_duplicates_removed:bigint,final_count:bigint>"))
    return out.select(F.lit(name).alias("dataset_name"), "total_samples", "train_samples", "val_samples", "test_samples", "dedup_metadata", "origins", "domains")


def build_benchmark(rows: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Canonical rows as a benchmark: the first row of each normalised text, with a split that keeps lineages together; and dedup counts."""
    from ..operators import curation

    shared_folder(rows.sparkSession)
    unique = curation.exact_dedup(rows, "sample_id").checkpoint()
    groups = curation.lineage_roots(unique.select(F.col("sample_id").alias("id"), "parent_id"))
    splits = curation.grouped_split(groups, train, val, seed).select(F.col("id").alias("sample_id"), F.col("split").alias("part"))
    out = unique.join(splits, "sample_id").withColumn("split", F.col("part")).select(*rows.columns)
    return out, curation.dedup_report(rows)


def save_benchmark(rows: DataFrame, folder: str, name: str = "benchmark", **shares) -> str:
    """Dedup, grouped split and save of canonical rows in one job; returns the folder."""
    shared_folder(rows.sparkSession)
    built, dedup = build_benchmark(rows, **shares)
    save_splits(built.checkpoint(), folder, name, dedup)
    return folder


def save_results(results: DataFrame, path: str) -> None:
    """Metric rows (as evaluate(), ablation() and adversarial_benchmark() give them) as a folder of JSON lines."""
    results.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Metrics that were saved: JSON lines, or one JSON document over several lines. A folder that isn't there gives one row (message)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([("Benchmark results not yet generated.",)], "message string")
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    whole = first is None or not (first.value.strip().startswith("{") and first.value.strip().endswith("}"))
    return spark.read.option("multiLine", whole).json(path)


def generated_corpus(spark: SparkSession, bank: dict[str, list[str]] | DataFrame, per_domain: int, origin: str, seed: int = 42, generator: str | None = None) -> DataFrame:
    """Canonical rows made of 3 or 4 sentences drawn from a domain's bank, by hash instead of a shared random state.

    bank: sentences by domain, or a table (domain, bank) with one array a domain.
    """
    banks = bank if isinstance(bank, DataFrame) else spark.createDataFrame([(d, s) for d, s in sorted(bank.items())], "domain string, bank array<string>")
    rows = banks.select("domain", "bank", F.explode(F.sequence(F.lit(0), F.lit(per_domain - 1))).alias("k"))
    u = lambda x: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(origin), "domain", F.col("k").cast("string"), x))  # noqa: E731  also other engines' draw
    order = F.array_sort(F.transform("bank", lambda s, i: F.struct(u(i.cast("string")).alias("u"), s.alias("s"))))
    odd = F.conv(F.substring(u(F.lit("n")), 1, 1), 16, 10).cast("int") % 2
    text = F.array_join(F.transform(F.slice(order, F.lit(1), 3 + odd), lambda x: x["s"]), " ")
    rows = rows.select(F.concat_ws("_", F.lower(F.lit(origin)), F.lower("domain"), "k").alias("sample_id"), text.alias("text"), F.lit(origin).alias("origin"), "domain", F.lit("generated").alias("source_dataset"), F.lit(generator).cast("string").alias("generator"))
    return canonical(rows)


def humanized_children(rows: DataFrame, seed: int = 42) -> DataFrame:
    """AI_HUMANIZED children of rows: technique, humanizer and severity one of four, drawn by hash of sample_id, with parent_id."""
    from ..operators import perturb

    key, text = F.col("sample_id"), F.col("text")
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit("turn"), F.lit(str(seed)))), 1, 1), 16, 10).cast("int") % 4
    variants = [(perturb.humanizer(text, key, "medium", seed), "humanizer_medium", "MEDIUM"), (perturb.humanizer(text, key, "high", seed), "humanizer_high", "HEAVY"), (perturb.synonym(text, key, 0.3, seed), "synonym", "LIGHT"), (perturb.jitter(text, key, seed), "jitter", "LIGHT")]
    pick = lambda k: F.when(turn == 0, variants[0][k] if k == 0 else F.lit(variants[0][k])).when(turn == 1, variants[1][k] if k == 0 else F.lit(variants[1][k])).when(turn == 2, variants[2][k] if k == 0 else F.lit(variants[2][k])).otherwise(variants[3][k] if k == 0 else F.lit(variants[3][k]))
    # The text is made before sample_id is named anew: lambdas would take an alias of that name in the same select for the key.
    rows = rows.select(key.alias("parent_id"), pick(0).alias("text"), "domain", "source_dataset", "generator", pick(1).alias("humanizer"), pick(2).alias("transformation_severity"))
    return canonical(rows.withColumn("sample_id", F.concat(F.lit("humanized_"), F.col("parent_id"))).withColumn("origin", F.lit("AI_HUMANIZED")))


def export(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
