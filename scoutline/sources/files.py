"""Readers and writers: CSV (with or without a byte-order mark), workbooks, JSON, JSON lines, label maps, vector indexes, images, resumable work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header, doubled quotes and line breaks in fields; a byte-order mark is skipped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(id int, label) from an object with an id2label map, whose keys are strings."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "id2label map<string, string>").alias("m"))
    return rows.select(F.explode(F.transform_keys("m.id2label", lambda k, _: k.cast("int"))).alias("id", "label"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def pending(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows that a checkpoint does not have yet."""
    return df.join(done, key, "left_anti")


def vector_index(df: DataFrame) -> DataFrame:
    """(key, loc_id, vec): loc_id from the key's first part, vec of length 1 (a zero vector stays)."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return df.select("key", F.split("key", "_")[0].cast("long").alias("loc_id"), F.transform("vec", lambda x: x / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("vec"))


def write_vector_index(df: DataFrame, path: str) -> None:
    """Keys ("location_image") and their vectors of length 1, as a table that vector_index() reads again."""
    vector_index(df).select("key", "vec").write.mode("overwrite").parquet(path)


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    return vector_index(spark.read.parquet(path))


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON document (a label map, a report, a list of split rows on the driver) in the file path, wherever Spark can write."""
    import json

    _write_bytes(spark, json.dumps(value, ensure_ascii=False, indent=2).encode(), path)


def label_map(ids: DataFrame, label: str = "label", name: str = "label_id") -> dict:
    """{"label2id": ..., "id2label": ...} of dense ids."""
    rows = ids.select(label, name).distinct().orderBy(name).collect()  # a row a label
    return {"label2id": {r[0]: r[1] for r in rows}, "id2label": {str(r[1]): r[0] for r in rows}}


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """(key, path, content) of the image files of a folder, the key being the name without its suffix. Files that don't begin like
    an image of these kinds are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*suffixes))
    head = F.hex(F.substring("content", 1, 12))
    image = head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | (head.startswith("52494646") & head.endswith("57454250"))
    return files.where(image).select(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("key"), "path", "content")


def fetch(rows: DataFrame, done: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """(key, content) for rows (key, url) that done (key) doesn't have. get is an outside service; what it raises leaves a row out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, contents = [], []
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    content = get(url)
                except Exception:  # noqa: BLE001 - whatever the service raises
                    continue
                keys.append(key)
                contents.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(contents, pa.binary())], names=["key", "content"])

    wanted = rows.select(F.col("key").cast("string"), "url").where("url is not null").join(done.select(F.col("key").cast("string")), "key", "left_anti")
    return wanted.mapInArrow(run, "key string, content binary")


def resumed(df: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], every: int = 20) -> DataFrame:
    """work() on the rows that the table path doesn't have yet, every rows of them at a time (few, costly ones), each written before the
    next begins; then the table."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    todo = pending(df, spark.read.parquet(path).select(key), [key]) if there else df
    keys = [r[0] for r in todo.select(key).distinct().orderBy(key).toLocalIterator()]
    for k in range(0, len(keys), every):
        work(df.where(F.col(key).isin(*keys[k : k + every]))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def external_scores(df: DataFrame, key: str, scores: str) -> DataFrame:
    """df with scores, one for each row in the order of key, from a comma list or one a line; another count raises. The rows that
    are scored by hand are few: their keys are numbered on the driver."""
    parts = [x.strip() for x in scores.replace("\n", ",").split(",") if x.strip()]
    keys = [r[0] for r in df.select(key).orderBy(key).collect()]
    if len(keys) != len(parts) or len(set(keys)) != len(keys):
        raise ValueError(f"{len(parts)} scores for {len(keys)} rows")
    kind = df.schema[key].dataType.simpleString()
    given = df.sparkSession.createDataFrame(list(zip(keys, parts)), f"`{key}` {kind}, score string")
    return df.join(given, key).withColumn("score", F.col("score").try_cast("double"))


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A workbook's sheet as strings, its first row the header; a path that ends in .csv is read as that. A sheet has at most 2^20 rows,
    so it is parsed on the driver."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    tag = lambda name: f"{{{_SHEET}}}{name}"
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(x.text or "" for x in si.iter(tag("t"))) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(tag("si"))]
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(tag("row")):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(tag("c"))):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = k
                if letters:
                    at = -1
                    for ch in letters[0]:
                        at = (at + 1) * 26 + ord(ch) - 65
                value = c.find(tag("v"))
                text = "".join(x.text or "" for x in c.iter(tag("t"))) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    if not rows:
        return spark.createDataFrame([], "value string").drop("value")
    names = [x or f"_{k}" for k, x in enumerate(rows[0])]
    whole = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    return spark.createDataFrame(whole, ", ".join(f"`{n}` string" for n in names))


def write_xlsx(df: DataFrame, path: str, most: int = 1_048_575) -> None:
    """A workbook of one sheet with a header; more rows than a sheet can hold raise. Numbers stay numbers, all else is text."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(df.columns), *map(tuple, rows)])
    head, kinds = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_SHEET}" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{_SHEET}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    _write_bytes(df.sparkSession, out.getvalue(), path)


def _write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
