"""The batch engine: everything that is derived from events and content, each as a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.config import EngineConfig, Rules
from glimmer.operators import blocks
from glimmer.operators import cells as C
from glimmer.operators import sessions as S
from glimmer.operators import tiers


class Engine:
    """Lazy: a query runs only what it reads, and Catalyst sees one plan from the scan to the result."""

    def __init__(self, landing: DataFrame, content: DataFrame, cfg: EngineConfig, rules: Rules = Rules(), as_of=None) -> None:
        self.landing, self.content, self.cfg, self.rules, self.as_of = landing, content, cfg, rules, as_of

    @cached_property
    def events(self) -> DataFrame:
        return S.project_landing(self.landing)

    @cached_property
    def stated(self) -> DataFrame:
        return S.running_state(S.collapse(S.classify(self.events, self.rules)))

    @cached_property
    def segments(self) -> DataFrame:
        return S.segments(self.stated, self.cfg)

    @cached_property
    def islands(self) -> DataFrame:
        return S.islands(self.segments)

    @cached_property
    def sessions(self) -> DataFrame:
        return S.session_intervals(self.islands, self.content, self.cfg, self.as_of)

    @cached_property
    def versioned(self) -> DataFrame:
        """Session rows, each with the time of its last event as its version: when it was last derived."""
        seen = C.last_seen(self.events).select(S.SESSION, F.unix_millis("last_ts").alias("version"))
        return self.sessions.drop("version").join(seen, S.SESSION)

    @cached_property
    def intervals(self) -> DataFrame:
        return C.unpack(self.sessions)

    @cached_property
    def atoms(self) -> DataFrame:
        return C.expand(self.intervals, self.cfg)

    @cached_property
    def cells(self) -> DataFrame:
        return C.count_cells(self.atoms)

    @cached_property
    def cells_sweep(self) -> DataFrame:
        return C.by_sweep(self.intervals, self.cfg)

    @cached_property
    def islands_blocked(self) -> DataFrame:
        return blocks.islands_of_events(self.events, self.cfg, self.rules)

    def user_bitmaps(self) -> DataFrame:
        return C.bitmap_cells(self.atoms, "user_id", C.numbered(self.events, "user_id"))

    @cached_property
    def cells_independent(self) -> DataFrame:
        return C.session_independent(self.segments, self.content, self.cfg)

    @cached_property
    def cells_extended(self) -> DataFrame:
        return C.extended(self.sessions, self.events, self.cfg)

    @cached_property
    def boundary(self) -> DataFrame:
        return tiers.split_at(self.events, self.cfg)

    @cached_property
    def cold(self) -> DataFrame:
        return tiers.cold(self.intervals, self.boundary, self.cfg)

    @cached_property
    def hot(self) -> DataFrame:
        return tiers.hot(self.intervals, self.boundary, self.cfg)

    @cached_property
    def now(self) -> DataFrame:
        """What is served: both tiers, told apart by a column; the cells are derived once."""
        return tiers.tiered(self.cells, self.boundary)

    def cold_after(self, late: Column) -> DataFrame:
        """Cold cells as a live path has them after late events (late: a condition on landing rows): those without them, and what they change."""
        early = Engine(self.landing.where(~late), self.content, self.cfg, self.rules, self.as_of)
        derived = self.landing.where(late).select(S.SESSION).distinct()
        bounded = [rows.join(F.broadcast(self.boundary)) for rows in (early.intervals, self.intervals)]
        changes = tiers.corrections(*bounded, derived, self.cfg, F.timestamp_seconds(F.lit(0)), F.col("wm"))
        return tiers.corrected(tiers.cold(early.intervals, self.boundary, self.cfg), changes)

    def sweep(self, foreground_resumes: bool, grace_seconds: int, gap_seconds: int) -> DataFrame:
        """Session cells under other knobs, with the sweep's own classifier and islands that only gaps split."""
        cfg = EngineConfig(self.cfg.bucket_seconds, grace_seconds, gap_seconds - grace_seconds)
        merged = S.islands(S.active_segments(self.events, cfg, Rules.sweep(foreground_resumes)), ())
        atoms = C.expand(S.enrich(merged, self.content), cfg)
        keys = ("country", "platform", "video_type", "category", "content_id", "minute")
        return atoms.groupBy(*keys).agg(F.count_distinct(S.SESSION).alias("concurrent"))
