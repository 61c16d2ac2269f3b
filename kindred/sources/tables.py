"""Reading and writing linkage tables: tab-separated sources, id lists, score parts, and the output validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD, quoted: bool = False) -> DataFrame:
    """Tab-separated with a header; nulls become ''. Unless quoted, a quotation mark is an ordinary character."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
    df = reader.option("quote", '"' if quoted else "").csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def union_sources(tables: dict[int, DataFrame]) -> DataFrame:
    out = None
    for k, df in tables.items():
        one = df.withColumn("source", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def explode_ids(lists: DataFrame, key: str, ids: str) -> DataFrame:
    """(s1, pool) of comma lists; blanks are dropped."""
    items = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col(key).alias("s1"), F.explode(items).alias("pool"))


def id_lists(s1: DataFrame, pairs: DataFrame, order: str | None = None) -> DataFrame:
    """(s1, ids) for every s1: ids comma-joined without repeats, in the given order, '' without any."""
    item = F.struct(F.col(order or "pool").alias("o"), F.col("pool").alias("p"))
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"].cast("string"))), ",").alias("ids"))
    return s1.select("s1").join(lists, "s1", "left").select("s1", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str) -> None:
    lists.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)


def write_score_parts(scores: DataFrame, path: str, rows: int, parts: int) -> None:
    """Zstandard Parquet in order of (s1, pool), at most `rows` rows a file."""
    scores.repartitionByRange(parts, "s1", "pool").sortWithinPartitions("s1", "pool").write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def read_scores(spark: SparkSession, path: str, least: float = 0.001) -> DataFrame:
    """Pairs of a score dataset from a probability on; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("prob") >= least)


def validate(lists: DataFrame, s1: DataFrame, targets: DataFrame, candidates: DataFrame | None = None, prefixes: str | None = None) -> DataFrame:
    """(rule, n, example): broken rules of id lists (s1, ids) against the s1 ids and the ids that may be matched, and,
    if given, against candidates (s1, pool), of which matches are a part, and a pattern of how ids begin."""
    items = lists.select("s1", F.posexplode(F.split("ids", ",")).alias("at", "id")).where(F.col("id") != "")
    known = targets.select(F.col("pool").cast("string").alias("id"), F.lit(True).alias("known")).distinct()
    pair = F.concat_ws(":", "s1", "id").alias("what")
    rules = {
        "duplicate_s1": lists.groupBy("s1").count().where("count > 1").select(F.col("s1").cast("string").alias("what")),
        "duplicate_id": items.groupBy("s1", "id").count().where("count > 1").select(pair),
        "self_match": items.where(F.col("s1").cast("string") == F.col("id")).select(pair),
        "unknown_id": items.join(known, "id", "left_anti").select(pair),
        "missing_s1": s1.join(lists, "s1", "left_anti").select(F.col("s1").cast("string").alias("what")),
        "extra_s1": lists.join(s1, "s1", "left_anti").select(F.col("s1").cast("string").alias("what")),
    }
    if prefixes is not None:
        rules["wrong_prefix"] = items.where(~F.col("id").rlike(f"^(?:{prefixes})")).select(pair)
    if candidates is not None:
        rules["not_candidate"] = items.join(candidates.select("s1", F.col("pool").cast("string").alias("id")), ["s1", "id"], "left_anti").select(pair)
    out = None
    for rule, df in rules.items():
        one = df.select(F.lit(rule).alias("rule"), "what")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rule").agg(F.count("*").alias("n"), F.min("what").alias("example"))


def validate_file(spark: SparkSession, path: str, columns: tuple[str, str], s1: DataFrame, targets: DataFrame, candidates: DataFrame | None = None, prefixes: str | None = None) -> DataFrame:
    """(rule, n, example) of an id-list file: no header, one of other columns, commas for tabs, rows without a tab;
    and, of the rows that can be read, validate()'s rules."""
    lines = spark.read.text(path)
    header = "\t".join(columns)
    head = lines.where(F.lower(F.trim("value")) == header).select("value")
    if head.isEmpty():
        first = lines.limit(1).select(F.when(~F.contains("value", F.lit("\t")) & F.contains("value", F.lit(",")), "comma_separated").otherwise("wrong_header").alias("rule"), F.col("value").alias("example"))
        found = first.select("rule", F.lit(1).cast("long").alias("n"), "example")
        return found if not found.isEmpty() else spark.createDataFrame([("empty_file", 1, path)], "rule string, n long, example string")
    rows = lines.where((F.lower(F.trim("value")) != header) & (F.trim("value") != ""))
    broken = rows.where(~F.contains("value", F.lit("\t"))).groupBy(F.lit("malformed_row").alias("rule")).agg(F.count("*").alias("n"), F.min("value").alias("example"))
    lists = rows.where(F.contains("value", F.lit("\t"))).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("s1"), F.trim(F.split_part("value", F.lit("\t"), F.lit(2))).alias("ids"))
    return validate(lists, s1, targets, candidates, prefixes).unionByName(broken)


def normalised(records: DataFrame) -> DataFrame:
    """All views of raw records (id, name, address, country) side by side."""
    from kindred.functions import text as tx

    views = records.select("id", tx.name_views(F.col("name")).alias("n"), tx.address_views(F.col("address")), F.lower(F.trim("country")).alias("country_norm"))
    alt = F.array_join(F.transform(F.filter(F.split("n.alt", " "), lambda t: t != ""), tx.skeleton), " ")
    return views.select("id", F.col("n.clean").alias("name_clean"), F.col("n.core").alias("name_core"), F.col("n.skel").alias("name_skel"), F.col("n.nospace").alias("name_ns"), F.col("n.alt").alias("name_alt"), alt.alias("name_alt_skel"), F.col("a.clean").alias("addr_clean"), "a.postal", "a.nums", "a.landmarks", "country_norm")


def read_cached(spark: SparkSession, parquet: str, tsv: str) -> DataFrame:
    """The Parquet copy if it is there, else the tab-separated file; nulls and words for null become ''."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(parquet)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    df = spark.read.parquet(parquet) if there else read_tsv(spark, tsv)
    clean = lambda c: F.coalesce(F.when(~F.col(c).cast("string").isin("<NA>", "nan", "None"), F.col(c).cast("string")), F.lit(""))
    return df.select(*[clean(c).alias(c) for c in df.columns])


def read_gzip_parts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Rows of tab-separated files with a header that were compressed whole and cut into name.gz.part00, part01 ..:
    each file's parts stream through one decompressor, in order, in one task; files are read beside each other."""
    import zlib

    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz.part*").load(folder)
    cut = files.select(F.regexp_extract("path", r"^(.*\.gz)\.part([0-9]+)$", 1).alias("file"), F.regexp_extract("path", r"\.part([0-9]+)$", 1).cast("int").alias("part"), "content")

    def rows(batches):  # noqa: ANN001, ANN202
        at, unzip, rest, header = None, None, b"", True
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                if file != at:
                    if rest:
                        yield _rows([rest], columns, pa)
                    at, unzip, rest, header = file, zlib.decompressobj(31), b"", True
                *lines, rest = (rest + unzip.decompress(content)).split(b"\n")
                if lines:
                    yield _rows(lines[1:] if header else lines, columns, pa)
                    header = False
        if rest:
            yield _rows([rest], columns, pa)

    dealt = cut.repartition("file").sortWithinPartitions("file", "part").select("file", "content")
    return dealt.mapInArrow(rows, ", ".join(f"{c} string" for c in columns))


def _rows(lines: list[bytes], columns: list[str], pa):  # noqa: ANN001, ANN202
    cells = [x.decode().rstrip("\r").split("\t") for x in lines]
    return pa.record_batch([pa.array([c[i] if i < len(c) else "" for c in cells], pa.string()) for i in range(len(columns))], names=columns)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of texts, numbers or lists, as text: dictionaries, vocabularies, fillers."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def write_json_map(rows: DataFrame, path: str) -> None:
    """A (key, value) table as a JSON object a part, in one file: only for tables of a resource's size."""
    rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))).alias("value")).coalesce(1).write.text(path)
