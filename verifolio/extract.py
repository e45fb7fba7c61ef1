"""The document pipeline: route, check the raw answer, repair, measure, plan.

Every step is a DataFrame; nothing runs until one is used. Checks see the raw answers;
repairs never reorder: lines, then rows, then what was read off pictures, then look.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema
from .functions import text as T
from .operators import checks, repair, select, spatial
from .plans import markdown, sheet, word
from .schema import KEY
from .sinks import office


@dataclass
class Inputs:
    """The tables of ``schema``: what the file itself says, and the model's answers."""

    pages: DataFrame
    spans: DataFrame
    geo: DataFrame
    detected: DataFrame
    images: DataFrame
    answers: DataFrame


@dataclass
class Extraction:
    pages: DataFrame  # routed pages with their final blocks; status ok, failed or image
    findings: DataFrame  # of the raw answers
    verdicts: DataFrame
    blocks: DataFrame  # final, one row each
    images: DataFrame  # embedded pictures, placed
    separate_images: DataFrame
    layout: DataFrame  # one row per document
    pictures: DataFrame  # of both, with their bytes

    def markdown(self, titles: DataFrame | None = None) -> DataFrame:
        return markdown.render_documents(self.pages.where("status = 'ok'"), titles)

    def word(self) -> DataFrame:
        return word.word_plan(self.pages.where("status <> 'failed'"), self.images, self.layout)

    def sheet_items(self) -> DataFrame:
        return sheet.sheet_items(self.pages.where("status <> 'failed'"), self.images)

    def word_files(self) -> DataFrame:
        return office.word_files(self.word(), self.pictures, self.layout)

    def sheet_files(self) -> DataFrame:
        items = self.sheet_items()
        cells = sheet.sheet_cells(items)
        return office.sheet_files(cells, sheet.column_widths(cells), sheet.sheet_pictures(items), self.pictures)

    def scan_files(self) -> DataFrame:
        pages = self.pages.withColumn("blocks", F.coalesce("blocks", F.array().cast(self.pages.schema["blocks"].dataType)))
        return office.scan_files(word.scan_plan(pages, self.separate_images, self.layout), self.pictures, self.layout)

    def problems(self) -> DataFrame:
        return word.write_problems(self.pages.where("status = 'ok'"))

    def coverage(self, read: DataFrame, every_page: bool = False) -> DataFrame:
        """Coverage of each document's text by what a written file holds (doc_id, text).
        Pages whose answer failed count only with ``every_page``."""
        pages = self.pages if every_page else self.pages.where("status <> 'failed'")
        texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "verify_text"))), lambda x: x["verify_text"]), "\n").alias("source"))
        return checks.readback(texts.join(read.select("doc_id", F.col("text").alias("read")), "doc_id"), "source", "read").drop("source", "read")


def extract(inputs: Inputs, mode: str = "text", work: str | None = None) -> Extraction:
    """All of it, for a scan mode: text, image or both.

    Steps that several later ones read are materialised, or a plan would compute them again
    for each: as Parquet under ``work``, which every executor must reach, or persisted
    where it is not given."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        if work is None:
            return df.persist()
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    routed = select.route_pages(inputs.pages, mode)
    # pages kept as an image have no answer to ask for or to check
    parsed = schema.parse_model_pages(inputs.answers.join(routed.where("not image_only").select(*KEY), KEY))
    raw = routed.join(parsed, KEY, "left").withColumn(
        "status", F.when(F.col("image_only"), "image").otherwise(F.coalesce("status", F.lit("failed")))
    )
    raw = keep(raw, "raw")
    good = raw.where("status = 'ok'").withColumn("produced", checks.produced_text(F.col("blocks")))
    raw_blocks = keep(schema.explode_blocks(good), "raw_blocks")
    grounded = keep(checks.grounding(raw_blocks, good, "verify_text"), "grounded")
    label = F.struct(F.lit("grounding").alias("check"), F.lit("problem").alias("severity"), F.col("message"))
    columns = [*KEY, "block_ord", "check", "severity", "message"]
    findings = [
        checks.structure(good),
        schema.page_findings(good),
        schema.validate(raw_blocks),
        grounded.where("message is not null").select(*KEY, "block_ord", label.alias("f")).select(*KEY, "block_ord", "f.*"),
        checks.geometry(raw_blocks, inputs.detected),
        checks.coverage_findings(good, "verify_text", "produced"),
    ]
    every = findings[0].select(*columns)
    for f in findings[1:]:
        every = every.unionByName(f.select(*columns))
    covered = checks.coverage(good.select(*KEY, "verify_text", "produced"), "verify_text", "produced")
    verdicts = checks.verdicts(good, checks.grounding_share(grounded), covered)

    lines = keep(spatial.line_table(inputs.spans), "lines")
    gone = checks.missing_lines(good.where("verify_trust = 'pdf'"), "verify_text", "produced")
    lined = repair.restore_lines(good.drop("produced"), lines, gone, inputs.detected)
    pictures = keep(select.extracted_images(inputs.images), "pictures")
    placed = spatial.image_places(pictures.drop("data"), inputs.geo)
    use = routed.select(*KEY, "image_use", "image_only")
    placed = keep(placed.join(use, KEY), "placed")
    embedded = placed.where("image_use = 'embed'").drop("image_use", "image_only")
    separate = placed.where("image_use = 'separate'").drop("image_use", "image_only")

    blocks = keep(schema.explode_blocks(lined), "lined_blocks")
    pairs = repair.paired_tables(blocks.join(good.where("verify_trust <> 'ocr'").select(*KEY), KEY, "left_semi"), inputs.detected)
    fixed = repair.restore_rows(pairs).select(*KEY, "block_ord", F.col("rows").alias("new_rows"), F.col("n_data_rows").alias("new_n"))
    blocks = blocks.join(fixed, [*KEY, "block_ord"], "left").withColumns(
        {"rows": F.coalesce("new_rows", "rows"), "n_data_rows": F.coalesce("new_n", "n_data_rows")}
    ).drop("new_rows", "new_n")
    blocks = keep(checks.drop_hallucinated(keep(blocks, "rowed_blocks"), good, "verify_text", embedded), "grounded_blocks")
    looked = spatial.measure_look(blocks.join(good.where("not scanned").select(*KEY), KEY, "left_semi"), lines, inputs.pages).drop("measured")
    blocks = keep(looked.unionByName(blocks.join(good.where("scanned").select(*KEY), KEY, "left_semi")), "blocks")

    names = [c for c in raw.columns if c != "blocks"]
    none = F.array().cast(raw.schema["blocks"].dataType)
    final = raw.select(*names).join(schema.gather_blocks(blocks), KEY, "left")
    final = keep(final.withColumn("blocks", F.when(F.col("status") == "failed", F.lit(None)).otherwise(F.coalesce("blocks", none))), "pages")
    targets = final.where("status <> 'failed'").select(*KEY, F.col("page_no").alias("target_ord"))
    layout = spatial.document_layout(spatial.page_layout(inputs.pages, inputs.geo, inputs.spans), targets)
    return Extraction(final, every, verdicts, blocks, embedded, separate, layout, pictures)


def page_text(df: DataFrame) -> DataFrame:
    """The text of a page's blocks, for search or export."""
    return df.select(*KEY, checks.produced_text(F.col("blocks")).alias("text")).where(~T.blank(F.col("text")))
