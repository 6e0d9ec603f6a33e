"""Sinks: the corpus as Parquet, concordances as table files, evidence with digests, a registry."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import Corpus
from ..operators.kwic import export

MAX_LINES = 1_000_000


def write_corpus(corpus: Corpus, path: str) -> None:
    """tokens/, docs/ and lexicon/ as Parquet; the manifest last, so a folder with one is whole."""
    corpus.tokens.repartition("doc_id").sortWithinPartitions("doc_id", "tok_idx").write.mode("overwrite").parquet(f"{path}/tokens")
    corpus.docs.write.mode("overwrite").parquet(f"{path}/docs")
    corpus.lexicon().write.mode("overwrite").parquet(f"{path}/lexicon")
    spark = corpus.tokens.sparkSession
    manifest = {"attributes": corpus.attributes(), "meta": corpus.meta, "version": 1}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    corpus = Corpus(spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/docs"), manifest["meta"])
    if missing := set(manifest["attributes"]) - set(corpus.attributes()):
        raise ValueError(f"the manifest names attributes that the tokens lack: {', '.join(sorted(missing))}")
    return corpus


class Registry:
    """Corpora by name; one is active."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.active = spark, {}, None

    def register(self, name: str, path: str) -> None:
        self.paths[name] = path
        self.active = self.active or name

    def activate(self, name: str) -> Corpus:
        if name not in self.paths:
            raise KeyError(f"no corpus {name!r}; there are {', '.join(sorted(self.paths))}")
        self.active = name
        return open_corpus(self.spark, self.paths[name])

    def delete(self, name: str) -> None:
        del self.paths[name]
        self.active = next(iter(self.paths), None) if self.active == name else self.active


def write_concordance(rows: DataFrame, path: str, kind: str = "csv", mask: bool = False) -> None:
    """CSV, TSV, JSON Lines or Parquet; at most a million lines, table files with the formula guard."""
    if kind not in ("csv", "tsv", "jsonl", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    out = export(rows.limit(MAX_LINES), mask)
    writer = out.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')
    elif kind == "jsonl":
        writer.json(path)
    else:
        writer.parquet(path)


def write_xlsx(rows: DataFrame, path: str, mask: bool = False, limit: int = MAX_LINES) -> int:
    """A workbook with one sheet of text cells, written row by row on the driver; the rows' number."""
    from xml.sax.saxutils import escape

    out = export(rows.limit(limit), mask)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="lines" sheetId="1" r:id="r1"/></sheets></workbook>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_printable(str(v)))}</t></is></c>'
            line = lambda vs: ("<row>" + "".join(map(cell, vs)) + "</row>").encode()
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode() + line(out.columns))
            for r in out.toLocalIterator():
                f.write(line(r))
                n += 1
            f.write(b"</sheetData></worksheet>")
    return n


def _printable(text: str) -> str:
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


def evidence(rows: DataFrame, about: dict) -> dict:
    """A record of a result: its method, its size and a digest that does not depend on row order."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    # the digests' first 15 hex digits are summed, so that no task needs all rows
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)"))).first()
    return {"method": about, "rows": n, "columns": sorted(rows.columns), "digest": f"{int(total):x}"}


def method_card(name: str, corpus: Corpus, **parameters) -> dict:
    """What a result rests on: operation, parameters, attributes and totals."""
    totals = corpus.totals().first()
    return {"operation": name, "parameters": parameters, "attributes": sorted(corpus.attributes()), "totals": totals.asDict()}
