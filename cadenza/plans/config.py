"""Settings of an encoding plan and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the quality, bandwidth as a share of the rate, the bit rate of a channel that asks for all of it, the widest bandwidth
#: from a bit rate and the narrowest of all, bits a second that ask for a quality of 1, and the quality from which it rises faster.
QUALITY_MIN, QUALITY_MAX = 10, 5000
SHARE, WHOLE, WIDEST, NARROWEST, BITS_A_QUALITY, KNEE, SLOPE = 0.42, 50000, 18000, 100, 1280, 100, 3


@dataclass(frozen=True)
class Settings:
    """Zero means not set. bitrate is for one channel."""

    rate: int = 44100
    channels: int = 2
    bitrate: int = 64000
    bandwidth: int = 0
    quality: int = 0
    noise_level: int = 4
    mpeg2: bool = False
    low_channel: bool = True
    noise_shaping: bool = False
    joint: str = "intensity"
    forced_block: str | None = None

    def resolved(self) -> Settings:
        """Validated settings with bandwidth and quality filled in and everything within its limits."""
        if not 0 < self.channels <= 64 or self.rate <= 0:
            raise ValueError("channels must be 1 to 64 and rate positive")
        if self.joint not in ("none", "mid_side", "intensity") or self.forced_block not in (None, "long", "short"):
            raise ValueError("unknown joint mode or block type")
        bitrate = min(self.bitrate, self.rate * 64 // self.channels)
        bandwidth, quality = self.bandwidth, self.quality
        if bitrate and not bandwidth:
            bandwidth = min(int(bitrate * self.rate * SHARE / WHOLE), WIDEST)
            if not quality:
                quality = bitrate * self.channels / BITS_A_QUALITY
                quality = (quality - KNEE) * SLOPE + KNEE if quality > KNEE else quality
        quality = quality or 100
        bandwidth = bandwidth or int(SHARE * self.rate)
        return replace(
            self, bitrate=bitrate, bandwidth=min(max(bandwidth, NARROWEST), self.rate // 2), quality=int(min(max(quality, QUALITY_MIN), QUALITY_MAX)),
            noise_level=0 if self.mpeg2 else min(max(self.noise_level, 0), 10),
        )

    def frame_bits(self) -> int:
        """Bits of a frame that keep the bit rate."""
        return self.channels * self.bitrate * 1024 // self.rate


def resolve(rows: DataFrame) -> DataFrame:
    """Settings.resolved for a table of settings (rate, channels, bitrate, bandwidth, quality; 0: not set), each row by its own values."""
    rate, channels, asked = F.col("rate"), F.col("channels"), F.col("bandwidth") > 0
    bitrate = F.least("bitrate", F.floor(rate * 64 / channels))
    derived = (bitrate > 0) & ~asked
    whole = lambda c: F.floor(c).cast("long")
    steady = bitrate * channels / float(BITS_A_QUALITY)
    quality = F.when(derived & (F.col("quality") == 0), F.when(steady > KNEE, (steady - KNEE) * SLOPE + KNEE).otherwise(steady)).otherwise(F.col("quality"))
    bandwidth = F.when(derived, F.least(whole(bitrate * rate * SHARE / WHOLE), F.lit(WIDEST))).when(asked, F.col("bandwidth")).otherwise(whole(rate * SHARE))
    limited = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), high)
    return rows.withColumns({
        "bitrate": bitrate,
        "bandwidth": limited(bandwidth, NARROWEST, whole(rate / 2)),
        "quality": whole(limited(F.when(quality > 0, quality).otherwise(100.0), QUALITY_MIN, F.lit(QUALITY_MAX))),
    })


def forced(frame_no: Column, settings: Settings, first: int = 0) -> Column | None:
    """Frames that take short blocks whatever they hold: the first one that is written, or all, or none, by the settings."""
    return None if settings.forced_block == "long" else F.lit(True) if settings.forced_block == "short" else frame_no == first
