"""A graph to look at: its layout, made once, and the calls that a viewer makes of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundle import Bundle
from .operators import layout, search, walks, windows
from .workspace import cut


class Browser:
    """Facts of a graph, and views of it as tables: each is a plan, and prunes what is stored by its bounds."""

    def __init__(self, bundle: Bundle):
        self.bundle = bundle

    @cached_property
    def nodes(self) -> DataFrame:
        """(node_id, x, len, backbone, lane), sorted by x."""
        return cut(layout.lanes(layout.positions(self.bundle)).repartitionByRange("x").sortWithinPartitions("x", "node_id"))

    @cached_property
    def _place(self):
        return layout.region(self.bundle).first()

    @property
    def region(self) -> str:
        return self._place["region"]

    @property
    def chromosome(self) -> str:
        return self._place["chrom"]

    @property
    def start(self) -> int:
        return self._place["start"]

    @cached_property
    def segments(self) -> int:
        return self.bundle.segments.count()

    @cached_property
    def haplotypes(self) -> int:
        return self.bundle.walks.count()

    @cached_property
    def span(self) -> int:
        return walks.span(self.bundle).first()[0] or 0

    def window(self, start: int, end: int, with_seq: bool = True, most: int | None = None) -> DataFrame:
        """Nodes that overlap [start, end); the longest `most` if there are more."""
        return windows.window(self.nodes, self.bundle.segments, start, end, with_seq, most)

    def window_edges(self, view: DataFrame) -> DataFrame:
        """Edges with both ends in a window()."""
        return windows.window_edges(self.bundle.edges, view)

    def overview(self) -> DataFrame:
        """The whole layout as one window."""
        return self.window(0, self.span)

    def density(self, start: int, end: int, bins: int) -> DataFrame:
        return windows.density(self.nodes, start, end, bins)

    def annotated(self, annotations: DataFrame) -> DataFrame:
        return windows.annotated(annotations, self.nodes, self.start)

    def matches(self, query: str, most: int) -> DataFrame:
        """Segments that hold the query, with their place in the layout."""
        found = search.matches(self.bundle, query, most)
        return found.join(self.nodes.select("node_id", "x", "lane", "len"), "node_id")

    def count_matches(self, query: str) -> int:
        return search.count_matches(self.bundle.segments, query).first()[0]

    def query(self, text: str, most: int, radius: int) -> str:
        """Hits with the graph around them, as JSON."""
        return search.query_json(self.bundle, text, most, radius).first()[0]

    def context(self, node: int, offset: int, strand: str, left: int, right: int) -> DataFrame:
        """The graph around one hit, further to one side than to the other if asked."""
        return search.context(self.bundle, node, offset, strand, left, right)

    def as_json(self, start: int, end: int, with_seq: bool = True, most: int | None = None) -> DataFrame:
        """(json): one document of a window, for a tile: what it holds is gathered into a row, as `most` bounds it."""
        view = cut(self.window(start, end, with_seq, most))
        node = F.struct("x", F.col("node_id").alias("id"), "lane", "len", F.col("backbone").alias("bb"), "kind", "seq")
        listed = view.agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"))
        edges = self.window_edges(view).agg(F.array_sort(F.collect_list(F.struct("edge_idx", F.array("from_id", "to_id").alias("e")))).alias("all"))
        facts = {"chrom": self.chromosome, "start": self.start, "span": self.span}
        fields = [*(F.lit(v).alias(k) for k, v in facts.items()), F.array(F.lit(start), F.lit(end)).alias("win"), "truncated", F.lit(self.segments).alias("n_nodes"), "nodes", F.transform("all", lambda x: x["e"]).alias("edges")]
        return listed.crossJoin(edges).select(F.to_json(F.struct(*fields)).alias("json"))
