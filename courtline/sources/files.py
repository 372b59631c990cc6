"""Files in and out: clip CSVs, label files, artefact manifests, and the tables that go out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

COORDINATES = ("ball_x", "ball_y", *(f"p{k}_{a}" for k in range(1, 7) for a in "xy"))
CLIP_SCHEMA = T.StructType([T.StructField("frame_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in COORDINATES), T.StructField("target_label", T.StringType())])


def _contents(lines: DataFrame, parts: Sequence[str], order: Sequence[str], end: str = "", name: str = "value") -> DataFrame:
    """``parts`` and the lines (value) of each in order, as one text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]), "\n")
    return lines.groupBy(*parts).agg((F.concat(whole, F.lit(end)) if end else whole).alias(name))


def write_text_files(lines: DataFrame, path: str, parts: Sequence[str], order: Sequence[str]) -> None:
    """One text file for each value of ``parts``, its lines (value) in order; folders are named after the values.

    A file's lines are one row, so this is for files of a clip or a picture. Nothing is written over.
    """
    _contents(lines, parts, order).write.partitionBy(*parts).mode("errorifexists").text(path)


def pack_text_files(lines: DataFrame, path: str, parts: Sequence[str], order: Sequence[str]) -> None:
    """The files of write_text_files() as a table: a row for each file, with ``parts`` and its content.

    For files by the million: a folder for each takes the driver a rename and a listing each, and its memory. Part
    files of the table are as many as tasks. Nothing is written over.
    """
    _contents(lines, parts, order, "\n", "content").write.mode("errorifexists").parquet(path)


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """What pack_text_files() was told by (``parts``), and a row for each line (value), as spark.read.text would split it."""
    files = spark.read.parquet(path)
    return files.select(*(c for c in files.columns if c != "content"), F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("value"))


def csv_lines(rows: DataFrame, columns: Sequence[str], key: str = "clip_id", order: str = "frame_id") -> DataFrame:
    """key, place and value: a header (place null, so it sorts first) and a line for each row; null is an empty cell."""
    cells = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    head = rows.select(key).distinct().select(key, F.lit(None).cast("long").alias("place"), F.lit(",".join(columns)).alias("value"))
    return head.unionByName(rows.select(key, F.col(order).cast("long").alias("place"), cells.alias("value")))


def _clip_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    if isinstance(path, DataFrame):
        return path
    lines = spark.read.text(path)
    return lines if "clip_id" in lines.columns else lines.select("value", F.col("_metadata.file_name").alias("clip_id"))


def missing_columns(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """clip_id, header and the required columns that each clip CSV lacks; files without a header have no row."""
    return _headers(_clip_lines(spark, path))


def _is_header() -> Column:
    return F.col("value").startswith("frame_id") | F.col("value").contains("ball_x")


def _headers(lines: DataFrame) -> DataFrame:
    need = F.array(*(F.lit(c) for c in CLIP_SCHEMA.names))
    return lines.where(_is_header()).select("clip_id", F.split("value", ",").alias("header")).withColumn("missing", F.array_except(need, "header"))


def scan_clips(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, skipped) of a directory of clip CSVs, or of their lines (clip_id, value); the columns of each file are found by name.

    A clip's name is its file's, or that of its folder ``clip_id=...``. frames: clip_id, video_key, folder,
    frame_id, coordinates and the clip's label (that of its first frame). A file without all columns, or with
    fewer than two rows, is skipped with a reason.
    """
    lines = _clip_lines(spark, path)
    heads = _headers(lines)
    good = heads.where(F.size("missing") == 0).select("clip_id", "header")
    rows = lines.where(~_is_header()).withColumn("cell", F.split("value", ",")).join(good, "clip_id").where(F.size("cell") == F.size("header")).withColumn("m", F.map_from_arrays("header", "cell"))
    typed = rows.select("clip_id", *(F.col("m")[f.name].try_cast(f.dataType).alias(f.name) for f in CLIP_SCHEMA.fields))
    stats = typed.groupBy("clip_id").agg(F.count("*").alias("n_rows"), F.min_by("target_label", "frame_id").alias("label"))
    frames = typed.drop("target_label").join(stats.where("n_rows >= 2"), "clip_id").withColumn("video_key", S.video_key(F.col("clip_id"))).withColumn("folder", F.regexp_extract("clip_id", r"^(.*?)__", 1))
    files = lines.select("clip_id").distinct().join(heads.select("clip_id", "missing"), "clip_id", "left").join(stats, "clip_id", "left")
    reason = F.when(F.col("missing").isNull(), "no header").when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ","))).when(F.coalesce("n_rows", F.lit(0)) < 2, "under two rows")
    return frames, files.select("clip_id", reason.alias("reason")).where("reason is not null")


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels from CSV; clip and label must be there."""
    out = spark.read.csv(path, header=True)
    if missing := {"clip", "label"} - set(out.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return out


def scan_label_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Lines of detector label files, of a folder or as a table (split, stem, value): stem, split and the parsed line.

    stem is the file's name without its ending and split the folder above, or what folders
    ``split=...`` and ``stem=...`` say.
    """
    lines = path if isinstance(path, DataFrame) else spark.read.text(path)
    of = lambda name, pattern: F.col(name) if name in lines.columns else F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    rows = lines.select("value", of("stem", r"([^/]+)\.\w+$").alias("stem"), of("split", r"([^/]+)/[^/]+$").alias("split"))
    return parse_label_lines(rows.where(F.trim("value") != ""))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Adds class, coords and kind (box, polygon or bad) to lines (value): 'class c1 c2 ...' with numbers in [0, 1].

    A class may be written as a decimal number; it is cut to its whole part.
    """
    token = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("token", token).withColumn("class", F.nullif(F.col("token")[0].try_cast("double"), F.lit(float("nan"))).try_cast("int")).withColumn("coords", F.transform(F.slice("token", F.lit(2), F.size("token")), lambda c: c.try_cast("double")))
    ok = F.col("class").isNotNull() & F.forall("coords", lambda c: c.isNotNull() & c.between(-0.001, 1.001))
    n = F.size("coords")
    return rows.withColumn("kind", F.when(ok & (n == 4), "box").when(ok & (n >= 6) & (n % 2 == 0), "polygon").otherwise("bad")).drop("token")


def label_file_audit(parsed: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Counts of boxes, polygons and bad lines, and of lines per class, for each split."""
    return parsed.groupBy(*keys).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("box", "polygon", "bad")), F.count_distinct("stem").alias("n_files"), F.count(F.when((F.col("class") == 0) & (F.col("kind") != "bad"), 1)).alias("n_class0"))


def image_label_pairing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images without labels and labels without images, by split and stem."""
    a, b = images.select("split", "stem", F.lit(1).alias("image")).distinct(), labels.select("split", "stem", F.lit(1).alias("labels")).distinct()
    both = a.join(b, ["split", "stem"], "full_outer")
    return both.select("split", "stem", F.when(F.col("labels").isNull(), "no label").when(F.col("image").isNull(), "no image").alias("problem")).where("problem is not null")


def file_manifest(spark: SparkSession, path: str | DataFrame, expected: Sequence[str] | DataFrame, by: str | None = None) -> DataFrame:
    """First 12 hex digits of SHA-256 and size of each expected file; null where it is missing.

    path: a folder, or a table of files (content, and what ``by`` names). expected: names, or a table with a
    column name. by: the folder level (``by=...``) that names a file instead of its own name.
    """
    name = F.col(by).cast("string") if by else F.regexp_extract("path", r"([^/]+)$", 1)
    found = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    files = found.select(name.alias("name"), F.substring(F.sha2("content", 256), 1, 12).alias("sha"), F.octet_length("content").cast("long").alias("size"))
    names = expected if isinstance(expected, DataFrame) else spark.createDataFrame([(x,) for x in expected], "name string")
    return names.join(files, "name", "left")


def write_clips(frames: DataFrame, path: str) -> None:
    """Labelled windows, one folder per label; an existing table is never written over."""
    frames.write.partitionBy("target_label").mode("errorifexists").parquet(path)


def probability_columns(windows: DataFrame, labels: Sequence[str], probs: str = "probs") -> DataFrame:
    """The probability map as one column per label."""
    return windows.select(*(c for c in windows.columns if c != probs), *(F.col(probs)[x].alias("p_" + x.lower().replace(" ", "_")) for x in labels))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Per-frame, per-window or per-clip rows as parquet, or as CSV with a header."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def summary_json(metrics: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def clip_summaries(clips: DataFrame, key: str, label: str) -> DataFrame:
    """One JSON text for each value of ``key``: number of clips, counts by label, the majority label and its share.

    Of labels with equal counts the first by name is the majority.
    """
    n = clips.groupBy(key, label).agg(F.count("*").alias("n"))
    most = F.min_by(F.struct(F.col(label).alias("label"), F.col("n").alias("n")), F.struct(-F.col("n"), F.col(label)))
    per = n.groupBy(key).agg(F.sum("n").alias("n_clips"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("class_counts"), most.alias("most"))
    majority = F.struct(F.col("most.label").alias("label"), F.round(F.col("most.n") / F.col("n_clips"), 4).alias("accuracy"))
    return summary_json(per.select(key, "n_clips", "class_counts", majority.alias("majority_baseline")))


def verify_labels(lines: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """What is wrong with detector labels: split, stem, line (0: the file itself) and problem.

    lines: split, stem, line and value; images: split and stem. Of a line the first fault counts: a
    token that is no number, a class outside 0..n_classes - 1, neither four coordinates nor an even
    number from six on, one outside [0, 1], a box or polygon without width or height. Blank lines are
    passed over. Pictures are not decoded.
    """
    token = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").withColumn("__v", F.transform(token, lambda t: t.try_cast("double")))
    rows = rows.withColumn("__class", F.col("__v")[0].cast("int")).withColumn("__c", F.slice("__v", 2, 1 << 20)).withColumn("__n", F.size("__c"))
    c, n = F.col("__c"), F.col("__n")
    along = lambda k: F.when(n == 4, F.array(F.get(c, k) - F.get(c, k + 2) / 2, F.get(c, k) + F.get(c, k + 2) / 2)).otherwise(F.filter(c, lambda _, i: i % 2 == k))
    flat = lambda v: F.array_max(v) - F.array_min(v) <= 0
    problem = (
        F.when(F.exists("__v", lambda v: v.isNull() | F.isnan(v)), "not a number")
        .when(~F.col("__class").between(0, n_classes - 1), "class out of range")
        .when((n != 4) & ((n < 6) | (n % 2 == 1)), "number of coordinates")
        .when(F.exists(c, lambda v: ~v.between(0, 1)), "coordinate out of range")
        .when(flat(along(0)) | flat(along(1)), "no width or height")
    )
    faults = rows.select("split", "stem", F.col("line").cast("long").alias("line"), problem.alias("problem")).where("problem is not null")
    pairs = image_label_pairing(images, lines).select("split", "stem", F.lit(0).cast("long").alias("line"), "problem")
    return faults.unionByName(pairs)


def label_verdict(faults: DataFrame, images: DataFrame) -> DataFrame:
    """PASS or FAIL and the number of faults for each split of images or faults."""
    n = faults.groupBy("split").agg(F.count("*").alias("n_faults"))
    both = images.select("split").distinct().join(n, "split", "full_outer").na.fill(0, ["n_faults"])
    return both.withColumn("verdict", F.when(F.col("n_faults") == 0, "PASS").otherwise("FAIL"))
