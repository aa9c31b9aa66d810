"""Project files: four JSON sections glued together by marker words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Section markers of the file format (fixed values).
SAVE_STATE, TEMP_IMAGES, DOCUMENT = "BEGINSAVESTATE", "BEGINTEMPIMAGES", "BEGINDOCUMENT"

STATE_SCHEMA = """
    layers map<string, struct<frames: array<struct<imageDataId: string, isOriginal: boolean, isSelected: boolean,
        refFrameLeftNr: int, refFrameRightNr: int, refFrameClosestNr: int, frameNr: int>>>>,
    ImageStore struct<imageDataById: map<string, struct<dataUri: string, hash: string, hashDirty: boolean,
        referenceCount: int, segmentationMapPath: string>>>,
    colorPalette array<struct<hex: string, newHex: string, visible: boolean, newVisible: boolean, opacity: int,
        newOpacity: int, selected: boolean>>,
    firstRealFrameNumber int, lastRealFrameNumber int
"""


def _between(text: Column, after: Column, before: Column | None) -> Column:
    return F.substring(text, after, (before - after) if before is not None else F.length(text))


def parse_projects(files: DataFrame, text: str = "text") -> DataFrame:
    """Sections of project texts. Every marker is searched from the start of the
    text, also inside of JSON strings; a file without a document section (the
    older format) has a null document."""
    t = F.col(text)
    at = {m: F.instr(t, m) for m in (SAVE_STATE, TEMP_IMAGES, DOCUMENT)}
    open_, close = F.instr(t, "["), F.instr(t, "]")
    has_document = at[DOCUMENT] > 0
    metadata = F.substring(t, open_, close)
    return files.select(
        *[c for c in files.columns if c != text],
        metadata.alias("metadata"),
        F.get_json_object(metadata, "$[0].version").alias("version"),
        _between(t, at[SAVE_STATE] + len(SAVE_STATE), at[TEMP_IMAGES]).alias("save_state"),
        _between(t, at[TEMP_IMAGES] + len(TEMP_IMAGES), F.when(has_document, at[DOCUMENT]).otherwise(F.length(t) + 1)).alias("temp_images"),
        F.when(has_document, _between(t, at[DOCUMENT] + len(DOCUMENT), None)).alias("document"),
    )


def serialize_projects(sections: DataFrame) -> DataFrame:
    """One text per project from its JSON sections; the document is optional."""
    tail = F.when(F.col("document").isNotNull(), F.concat(F.lit(DOCUMENT), "document")).otherwise("")
    text = F.concat("metadata", F.lit(SAVE_STATE), "save_state", F.lit(TEMP_IMAGES), "temp_images", tail)
    return sections.select("project_id", text.alias("text"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Parse all project files below a folder."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return parse_projects(
        raw.select(F.col("_metadata.file_path").alias("file"), F.rtrim(F.regexp_replace("value", "\n$", "")).alias("text"))
    )


def write_projects(sections: DataFrame, path: str) -> None:
    """One folder with one text file per project."""
    texts = serialize_projects(sections)
    texts.repartition("project_id").write.mode("errorifexists").partitionBy("project_id").text(path)


def project_tables(projects: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, images and swatches stored in save states; empty frame slots are
    dropped, the slot index is the frame number."""
    state = projects.select(key, F.from_json("save_state", STATE_SCHEMA).alias("s"))
    frames = (
        state.select(key, F.explode("s.layers").alias("layer", "l"))
        .select(key, "layer", F.posexplode("l.frames").alias("frame_nr", "f"))
        .where("f is not null")
        .select(
            key, "layer", "frame_nr", F.col("f.imageDataId").alias("image_id"),
            F.coalesce("f.isOriginal", F.lit(False)).alias("is_original"),
            F.coalesce("f.isSelected", F.lit(False)).alias("is_selected"),
            F.col("f.refFrameLeftNr").alias("ref_left"), F.col("f.refFrameRightNr").alias("ref_right"),
            F.col("f.refFrameClosestNr").alias("ref_closest"),
        )
    )
    images = state.select(key, F.explode("s.ImageStore.imageDataById").alias("image_id", "i")).select(
        key, "image_id", F.col("i.dataUri").alias("content"), F.col("i.hash").alias("hash"),
        F.col("i.hashDirty").alias("hash_dirty"), F.col("i.referenceCount").alias("reference_count"),
        F.col("i.segmentationMapPath").alias("seg_path"),
    )
    swatches = state.select(key, F.posexplode("s.colorPalette").alias("pos", "c")).select(
        key, "pos", F.col("c.hex").alias("hex"), F.col("c.newHex").alias("new_hex"), F.col("c.visible").alias("visible"),
        F.col("c.newVisible").alias("new_visible"), F.col("c.opacity").alias("opacity"),
        F.col("c.newOpacity").alias("new_opacity"), F.col("c.selected").alias("selected"),
    )
    return frames, images, swatches
