"""A segmentation of overlapping tiles that is kept up to date tile by tile.

Kept are the labelled tiles, the links between tile regions that meet on a border, and a forest: for
every tile region the root of the connected region it belongs to. When tiles change, only these tiles
are labelled, only their borders are compared, and only regions with a part in a changed tile or a new
link to one are opened and joined again; all else is neither read nor written. The tables are Parquet
folders partitioned by buckets, of tiles or of roots, so that an update touches the buckets it needs.

Tables under the folder (``bucket`` is the partition column):
``pixels``, the labelled tiles, and ``nodes`` (tile region, root, first pixel), by tile;
``members`` (root, tile region) and ``links`` (root, two tile regions), by root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flatcel.operators import scan as SC
from flatcel.operators import tiles as TI
from flatcel.operators.graph import components
from flatcel.operators.regions import PIXEL, label_tiles
from flatcel.operators.skew import join_unique
from flatcel.session import cut_lineage, drop_written

BUCKETS = 64
TILE_KEY = ["image_id", "ty", "tx"]
NODE = [*TILE_KEY, "label"]
ROOT = ["image_id", "root"]


def _bucket(*keys: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _by_tile(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", _bucket(*TILE_KEY, buckets=buckets))


def _by_root(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", _bucket("image_id", "root.ty", "root.tx", "root.label", buckets=buckets))


def _node(c: str) -> Column:
    return F.struct("image_id", f"{c}.ty", f"{c}.tx", f"{c}.label")


class TileForest:
    """The segmentation in ``folder``, tiles of ``size`` with ``overlap``."""

    def __init__(self, spark: SparkSession, folder: str, size: int = 512, overlap: float = 0.5, buckets: int = BUCKETS):
        self.spark, self.folder, self.size, self.overlap, self.buckets = spark, folder, size, overlap, buckets

    # --- tables ------------------------------------------------------------------

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{table}").where("image_id is not null")
        return (df if buckets is None else df.where(F.col("bucket").isin(buckets))).drop("bucket")

    def _write(self, table: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """Replace whole buckets (all of a new table). A row of nulls in each keeps a bucket that has
        lost all its rows from being left as it was. ``df`` must not read the table itself."""
        if buckets is not None:
            marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
            empty = self.spark.createDataFrame([], df.drop("bucket").schema)
            df = df.unionByName(empty.join(marks, F.lit(False), "right").select(df.columns))
        writer = df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.folder}/{table}")

    def _buckets(self, df: DataFrame) -> list[int]:
        """Numbers of the buckets of ``df``: at most ``buckets`` of them."""
        return sorted(r.bucket for r in df.select("bucket").distinct().collect())

    # --- building and updating -----------------------------------------------------

    def create(self, tiles: DataFrame, value: str = "v") -> None:
        """Segment all tiles of an overlapping mosaic (``tiles.tile``) from nothing."""
        fresh = cut_lineage(label_tiles(tiles, value))
        self._write("pixels", _by_tile(fresh, self.buckets))
        rooted, links = self._joined(self._regions(fresh), self._pairs(fresh))
        self._write("nodes", _by_tile(rooted, self.buckets))
        self._write("members", _by_root(rooted.select(*ROOT, "ty", "tx", "label"), self.buckets))
        self._write("links", _by_root(links, self.buckets))
        drop_written(fresh, rooted, links)

    def update(self, tiles: DataFrame, value: str = "v") -> None:
        """Replace the tiles in ``tiles``, each given whole, by new versions."""
        fresh = cut_lineage(label_tiles(tiles, value))
        changed = cut_lineage(fresh.select(*TILE_KEY).distinct())
        if changed.isEmpty():
            drop_written(fresh, changed)
            return
        steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
        around = changed.withColumn("s", F.explode(steps)).select(
            "image_id", (F.col("ty") + F.col("s.y")).alias("ty"), (F.col("tx") + F.col("s.x")).alias("tx")
        ).distinct()
        around = cut_lineage(_by_tile(around, self.buckets))
        near = self._buckets(around)
        own = self._buckets(_by_tile(changed, self.buckets))
        beside = around.select(*TILE_KEY).join(changed, TILE_KEY, "left_anti")
        # New links: borders of changed tiles with each other and with the tiles around them.
        old_pixels = self.read("pixels", near)
        met = fresh.unionByName(old_pixels.join(beside, TILE_KEY, "left_semi").select(fresh.columns))
        tile_of = changed.select("image_id", F.struct("ty", "tx").alias("t"))
        pairs = self._pairs(met).select("image_id", "a", "b", F.explode(F.array("a", "b")).alias("e"))
        touched = pairs.withColumn("t", F.struct("e.ty", "e.tx")).join(tile_of, ["image_id", "t"], "left_semi")
        new_pairs = cut_lineage(touched.select("image_id", "a", "b").distinct())
        # Regions to open: with a part in a changed tile, or met by a new link.
        ends = new_pairs.select("image_id", F.explode(F.array("a", "b")).alias("e")).select("image_id", "e.*").distinct()
        old_nodes = self.read("nodes", near)
        opened = cut_lineage(
            _by_root(
                old_nodes.join(changed, TILE_KEY, "left_semi").select(*ROOT)
                .unionByName(old_nodes.join(beside, TILE_KEY, "left_semi").join(ends, NODE, "left_semi").select(*ROOT))
                .distinct(),
                self.buckets,
            )
        )
        roots, root_buckets = opened.drop("bucket"), self._buckets(opened)
        members = cut_lineage(self.read("members", root_buckets).join(roots, ROOT, "left_semi"))
        tiles_hit = cut_lineage(_by_tile(members.select(*TILE_KEY).distinct(), self.buckets))
        node_buckets = sorted({*self._buckets(tiles_hit), *own})
        nodes = self.read("nodes", node_buckets)
        kept = nodes.join(members.select(*NODE), NODE, "left_semi").join(changed, TILE_KEY, "left_anti")
        old_links = self.read("links", root_buckets).join(roots, ROOT, "left_semi").select("image_id", "a", "b")
        for end in "ab":
            gone = changed.select("image_id", F.struct("ty", "tx").alias("t"))
            old_links = old_links.withColumn("t", F.struct(f"{end}.ty", f"{end}.tx")).join(gone, ["image_id", "t"], "left_anti").drop("t")
        rooted, links = self._joined(
            kept.drop("root").unionByName(self._regions(fresh).select(kept.drop("root").columns)), old_links.unionByName(new_pairs)
        )
        # Write the buckets that hold anything opened or new.
        tiles_out = self.read("pixels", own).join(changed, TILE_KEY, "left_anti").unionByName(fresh)
        rest = nodes.join(members.select(*NODE), NODE, "left_anti").join(changed, TILE_KEY, "left_anti")
        out = {"pixels": (_by_tile(tiles_out, self.buckets), own), "nodes": (_by_tile(rest.unionByName(rooted.select(rest.columns)), self.buckets), node_buckets)}
        new_roots = cut_lineage(_by_root(rooted.select(*ROOT).distinct(), self.buckets))
        all_roots = sorted({*root_buckets, *self._buckets(new_roots)})
        for name, fresh_rows in (("members", rooted.select(*ROOT, "ty", "tx", "label")), ("links", links)):
            stay = self.read(name, all_roots).join(roots, ROOT, "left_anti")
            out[name] = (_by_root(stay.unionByName(fresh_rows.select(stay.columns)), self.buckets), all_roots)
        ready = {name: (cut_lineage(df), buckets) for name, (df, buckets) in out.items()}
        for name, (df, buckets) in ready.items():
            self._write(name, df, buckets)
        drop_written(fresh, changed, around, new_pairs, opened, members, tiles_hit, rooted, links, new_roots, *[df for df, _ in ready.values()])

    def _regions(self, labelled: DataFrame) -> DataFrame:
        """Tile regions with the first of their pixels that show in the merged image (null if none)
        and the number of these."""
        shown = TI.merge_tiles(labelled, self.size, self.overlap).groupBy(*NODE).agg(
            F.min(F.struct("y", "x")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        return labelled.select(*NODE).distinct().join(shown, NODE, "left")

    def _pairs(self, labelled: DataFrame) -> DataFrame:
        return TI.border_pairs(labelled, self.size, self.overlap).select("image_id", "a", "b")

    def _joined(self, regions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Tile regions with the root of their connected region, and the links with theirs."""
        pairs = cut_lineage(pairs)
        found = components(pairs.select(_node("a").alias("src"), _node("b").alias("dst"))).select(
            F.col("node.image_id").alias("image_id"), F.col("node.ty").alias("ty"), F.col("node.tx").alias("tx"),
            F.col("node.label").alias("label"), F.struct("component.ty", "component.tx", "component.label").alias("__root"),
        )
        found = cut_lineage(found)
        rooted = cut_lineage(
            regions.join(found, NODE, "left").withColumn("root", F.coalesce("__root", F.struct("ty", "tx", "label"))).drop("__root")
        )
        links = pairs.select("*", "a.ty", "a.tx", "a.label").join(found, NODE, "left")
        links = links.select("image_id", F.coalesce("__root", "a").alias("root"), "a", "b")
        links = cut_lineage(links)
        drop_written(pairs, found)
        return rooted, links

    # --- reading ---------------------------------------------------------------------

    def labels(self) -> DataFrame:
        """The label image: regions numbered per image by their first pixel in raster order."""
        nodes = self.read("nodes")
        firsts = nodes.groupBy(*ROOT).agg(F.min("first").alias("f"), F.sum("n").alias("__n")).where("f is not null")
        firsts = firsts.select(*ROOT, "f.y", "f.x", "__n")
        numbered = SC.numbered(firsts, ["image_id"], ["y", "x"], SC.by_number("y", 64), "__pos").select(
            *ROOT, "__n", F.col("__pos").cast("int").alias("__label")
        )
        shown = TI.merge_tiles(self.read("pixels"), self.size, self.overlap).select(*PIXEL, "ty", "tx", "label")
        # A tile region has at most size x size pixels; a root may have any number.
        named = shown.join(nodes.select(*NODE, "root"), NODE).select(*PIXEL, "root")
        return join_unique(named, numbered, ROOT, "__n").select(*PIXEL, F.col("__label").alias("label"))
