"""Settings: time knobs, classification rules and dimension lists."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Time knobs in seconds; every operator takes them from here, so they can't disagree."""

    bucket_seconds: int = 60
    heartbeat_seconds: int = 60
    buffer_seconds: int = 30
    hot_window_seconds: int = 600
    lookback_seconds: int = 1200
    events_ttl_days: int = 30
    intervals_ttl_days: int = 3

    @property
    def gap_seconds(self) -> int:
        """Silence beyond this ends an active stretch."""
        return self.heartbeat_seconds + self.buffer_seconds


@dataclass(frozen=True)
class Rules:
    """Which event types and markers turn a session active or inactive.  Activation is tested first."""

    activating_types: tuple[str, ...] = ("VideoSessionStart", "VideoPlay", "AppForegrounded")
    activating_markers: tuple[str, ...] = ("resume", "speed-resume", "AdResume")
    deactivating_types: tuple[str, ...] = ("AppBackgrounded", "VideoSessionEnd", "VideoError", "VideoPause", "AdBreakStart")
    deactivating_markers: tuple[str, ...] = ("pause", "speed-pause", "AdPause")

    @classmethod
    def sweep(cls, foreground_resumes: bool) -> Rules:
        """The classifier of the knob sweep: starts are neutral, foregrounding is optional."""
        resumes = ("AppForegrounded",) if foreground_resumes else ()
        return cls(("VideoPlay", *resumes), deactivating_types=("AppBackgrounded", "VideoSessionEnd", "VideoError"))


CORE_DIMS = ("country", "platform", "video_type", "category", "content_id")
EXTENDED_DIMS = ("subtitle_language", "audio_language", "player_version", "app_version", "title")
#: The knobs that make the test tables' sparse events meaningful.
TESTDATA_CONFIG = EngineConfig(bucket_seconds=3600, heartbeat_seconds=14400, buffer_seconds=7200, hot_window_seconds=86400)
