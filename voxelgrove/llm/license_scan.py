"""License scans of a file tree: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Compared are all stretches of a text of as many words as a template, so that a name or a year beside a notice does not count against it, and a long licence is known by its title
or notice. Words are weighted by their inverse document frequencies over the templates: a fixed scale, so that no other file changes a verdict (``license_match.py``). A stretch counts
only if it has half of the template's words, names its versions and telling words, and no negation stands before it in its clause. A licence is taken if its best stretch reaches ``ACCEPT``
and is at least ``MARGIN`` above every other licence's there; of several in a file the most similar, then the first, then the least name. A tag ("SPDX-License-Identifier: ...", or
a line "License: ...") with an expression of known identifiers decides before all that and is given whole. A file without a licence of its
own takes that of the licence file in its directory or the nearest one above, found by joins on paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slice, written
from .license_match import Notices
from .license_texts import TEMPLATES

ACCEPT = 0.7
MARGIN = 0.002
SALTS = 32
LICENSE_FILES = ("license", "licence", "copying", "unlicense", "notice")


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] | None = None, keep: list[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """A row for each file: ``keep`` columns (all but the text if None), own_license and its score, license and the directory it came from (null for its own).

    Defined cases: a null or empty text has no licence of its own; a null path has no directory and inherits nothing; of several licence files in a
    directory the one with the highest score counts, then the least licence name; repeated files are scanned once each; an empty table stays empty;
    columns of ``files`` named like an added one are replaced.
    """
    added = ("own_license", "score", "license", "inherited_from")
    cols = [c for c in (keep or [c for c in files.columns if c != text]) if c not in added]
    known = Notices(TEMPLATES if templates is None else templates)
    rows = files.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{path}`").alias("_path"), F.col(f"`{text}`").alias("_text"))
    schema = rows.select(*cols, "_path", F.lit(None).cast("string").alias("own_license"), F.lit(0.0).alias("score")).schema

    def match(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        names, scores = zip(*known.decide(data, at, accept, MARGIN), strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    own = rows.mapInArrow(by_slice(match, "_text"), schema)
    found = written(own.withColumn("_dir", directory(F.col("_path"))).withColumn("_row", F.monotonically_increasing_id()), "own_licenses")
    name = F.lower(F.regexp_replace(F.regexp_extract(F.col("_path"), "([^/]*)$", 1), r"\..*$", ""))
    notices = found.where(name.isin(*LICENSE_FILES) & F.col("own_license").isNotNull()).select("_dir", "own_license", "score")
    top = notices.groupBy("_dir").agg(F.max("score").alias("score"))
    licensed = notices.join(top, ["_dir", "score"]).groupBy("_dir").agg(F.min("own_license").alias("dir_license"))
    # Directories, not files, look up their ancestors: each directory once, however many files it has.
    dirs = found.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    ancestors = dirs.select("_dir", F.explode(F.when(F.col("_dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    ancestors = ancestors.withColumn("above", F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.col("depth")), "/"))
    # The top of a tree is above every directory, so the lookups are spread over SALTS copies of the licensed directories.
    ancestors = ancestors.withColumn("salt", F.pmod(F.xxhash64("_dir"), F.lit(SALTS)).cast("int"))
    above = licensed.select(F.col("_dir").alias("above"), "dir_license", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    nearest = ancestors.join(above, ["above", "salt"]).groupBy("_dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n")).select("_dir", F.col("n.dir_license").alias("dir_license"), F.col("n.above").alias("above"))
    # Files look up their directory in SALTS copies too; those without a path have none.
    salted = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = found.where("_dir is not null").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["_dir", "_salt"], "left")
    out = inside.unionByName(found.where("_dir is null"), allowMissingColumns=True)
    own = F.col("own_license").isNotNull()
    return out.select(*cols, "own_license", "score", F.coalesce("own_license", "dir_license").alias("license"), F.when(~own, F.col("above")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source/thousands/fifties/name. A short text that mentions a licence stands for a licence file."""
    text = F.coalesce(F.col("text"), F.lit(""))
    short = (F.length(text) < 500) & F.lower(text).rlike("licen[cs]e")
    name = F.when(short, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")))
    number = F.col("doc_id").cast("long")
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(number / 1000), F.floor(number % 1000 / 50), name))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``, their own or inherited along their paths."""
    files = document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scan_licenses(files, keep=["doc_id", "path"])
