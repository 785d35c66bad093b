"""Row-wise expressions over codecs, gains, pans, levels and time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from timelane.functions.bits import field, has_bit, let

# The format and model constants.
CODECS = {0: "pcm", 4: "adpcm", 7: "mp3"}
FLAG_BITS = {
    "chunk_indices": 1,
    "single_channel_encrypt": 2,
    "multi_channel": 4,
    "multi_channel_encrypt": 8,
}
GAIN_MIN, GAIN_MAX = 0.0, 1.5
PAN_MIN, PAN_MAX = -1.0, 1.0
SILENT_GAIN = 0.0001
MIN_LOOP_SECONDS = 0.05
METER_FULL = 1.2
DANGER_LEVEL, WARN_LEVEL = 0.95, 0.75
DIRECTORY, BINARY, RESOURCE = "directory", "binary", "resource"


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def fixed(x: Column, places: int = 6) -> Column:
    """``x`` on a grid of ``10**-places``, for comparing sums of floats."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low=None, high=None) -> Column:
    """``x`` inside the given bounds; a missing bound does not apply."""
    out = x
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(x.isNotNull(), out)


def codec_name(codec_id: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for number, name in CODECS.items():
        out = out.when(codec_id == number, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def flag_bits(word: Column) -> dict[str, Column]:
    return {name: has_bit(word, mask) for name, mask in FLAG_BITS.items()}


def hash_hex(value: Column) -> Column:
    """At least eight digits; larger values keep all of theirs."""
    digits = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.repeat(F.lit("0"), F.greatest(8 - F.length(digits), F.lit(0))), digits)


def duration_seconds(samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, samples / rate).otherwise(F.lit(0.0))


def audible(muted: Column, solo: Column, any_solo: Column) -> Column:
    """Solo beats mute: with any solo in the mix only soloed tracks sound."""
    return F.when(any_solo, solo).otherwise(~muted)


def effective_gain(gain: Column, muted: Column, solo: Column, any_solo: Column) -> Column:
    return F.when(audible(muted, solo, any_solo), gain).otherwise(F.lit(0.0))


def envelope_value(
    t: Column, t0: Column, g0: Column, t1: Column, g1: Column, easing: Column
) -> Column:
    """Gain inside one segment; the easing belongs to the segment's end."""
    span = t1 - t0
    return (
        F.when(easing == "hold", g0)
        .when(span <= 0, g1)
        .otherwise(g0 + (g1 - g0) * ((t - t0) / F.when(span > 0, span)))
    )


def piecewise_gain(
    t: Column, first_time: Column, last_time: Column, envelope: Column, slider: Column,
    gate: Column,
) -> Column:
    """Envelope between the first and last keyframe (both included), slider outside."""
    inside = (t >= first_time) & (t <= last_time)
    return F.when(inside, envelope).otherwise(slider) * gate


def pan_spread(pan: Column) -> Column:
    return F.abs(pan)


def side_pan(spread: Column, side: Column) -> Column:
    s = clamp(spread, 0.0, 1.0)
    return F.when(side == "L", -s).otherwise(s)


def equal_power_pan(pan: Column) -> tuple[Column, Column]:
    """Left and right factor of a mono input at equal power."""
    x = (pan + 1.0) / 2.0
    return F.cos(x * (math.pi / 2.0)), F.sin(x * (math.pi / 2.0))


def entry_size(kind: Column, file_size: Column, unpacked: Column) -> Column:
    binary = F.when((unpacked > 0) | (file_size == 0), unpacked).otherwise(file_size)
    return F.when(kind == DIRECTORY, 0).when(kind == BINARY, binary).otherwise(file_size)


def entry_compressed(kind: Column, file_size: Column) -> Column:
    return (kind != DIRECTORY) & (file_size > 0)


def entry_encrypted(kind: Column, encryption_type: Column, name: Column) -> Column:
    return ((kind == BINARY) & (encryption_type == 1)) | (
        (kind == RESOURCE) & F.lower(name).endswith(".ysc")
    )


def quantize_pcm16(sample: Column) -> Column:
    s = clamp(sample.cast("double"), -1.0, 1.0)
    return F.when(s < 0, s * 32768).otherwise(s * 32767).cast("int")


def loop_bounds(a: Column, b: Column, duration: Column) -> tuple[Column, Column]:
    """Ordered ends inside the song; both null when shorter than the minimum."""
    low = clamp(F.least(a, b), 0.0, duration)
    high = clamp(F.greatest(a, b), 0.0, duration)
    long_enough = (high - low) >= MIN_LOOP_SECONDS
    return F.when(long_enough, low), F.when(long_enough, high)


def default_loop(last_start: Column, last_end: Column, duration: Column):
    """The last region if long enough, else the middle half of the song."""
    usable = F.coalesce((last_end - last_start) >= MIN_LOOP_SECONDS, F.lit(False))
    some = duration > 0
    return (
        F.when(some, F.when(usable, last_start).otherwise(duration * 0.25)),
        F.when(some, F.when(usable, last_end).otherwise(duration * 0.75)),
    )


def loop_wrap(position: Column, start: Column, end: Column) -> Column:
    """Fold a position past the loop end back into the loop."""
    size = end - start
    return F.when(position < end, position).otherwise(start + F.pmod(position - start, size))


def level_bar(peak: Column) -> Column:
    return F.least(F.lit(1.0), peak / METER_FULL)


def level_zone(peak: Column) -> Column:
    return (
        F.when(peak >= DANGER_LEVEL, "danger").when(peak >= WARN_LEVEL, "warn").otherwise("ok")
    )


def pair_zone(peak: Column) -> Column:
    """The pair list knows only the upper threshold."""
    return F.when(peak >= DANGER_LEVEL, "danger").otherwise("ok")


def jenkins29(text: Column) -> Column:
    """One-at-a-time hash of the lower-cased UTF-8 bytes, low 29 bits.

    The running value is kept one step short: the shift-xor that ends a byte is applied
    when the next byte (or the end) reads it. ``h + (h << 10)`` is ``h * 1025``.
    """
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    # One character per byte.
    letters = F.split(F.decode(F.encode(F.lower(text), "UTF-8"), "ISO-8859-1"), "")

    def shifted(h):
        return h.bitwiseXOR(F.shiftright(h, 6))

    def step(h, letter):
        return ((shifted(h) + F.ascii(letter)) * 1025).bitwiseAND(mask)

    def finish(h):
        spread = (shifted(h) * 9).bitwiseAND(mask)
        return let(spread, lambda x: (x.bitwiseXOR(F.shiftright(x, 11)) * 32769).bitwiseAND(mask))

    whole = F.aggregate(letters, F.lit(0).cast("bigint"), step, finish)
    return whole.bitwiseAND(F.lit(0x1FFFFFFF).cast("bigint"))


# kbit/s by bitrate index 0..14 from the public MPEG audio standard.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
MODE_NIBBLES = (0x0, 0x4, 0x5, 0x6, 0x7, 0x8, 0xC)


def frame_header_fields(word: Column) -> dict[str, Column]:
    """Fields of a 32-bit frame header word; ``valid`` tells a plausible header.

    ``version`` is 10, 20 or 25 (0 unknown). ``frame_size`` is null for the free format,
    whose size only the stream tells.
    """
    version_bits = field(word, 19, 3)
    layer_bits = field(word, 17, 3)
    rate_index = field(word, 12, 15)
    sample_index = field(word, 10, 3)
    nibble = field(word, 4, 15)
    valid = (
        (field(word, 21, 0x7FF) == 0x7FF)
        & (version_bits != 1)
        & (layer_bits != 0)
        & (rate_index != 15)
        & (sample_index != 3)
        & nibble.isin(*MODE_NIBBLES)
    )
    version = (
        F.when(version_bits == 0, 25).when(version_bits == 2, 20).when(version_bits == 3, 10)
        .otherwise(0)
    )
    layer = (4 - layer_bits) % 4
    table = F.create_map(
        *[
            x
            for (family, level), row in BITRATES.items()
            for x in (F.lit(family * 10 + level), F.array(*[F.lit(v) for v in row]))
        ]
    )
    family = F.when(version == 10, 1).otherwise(2)
    row = F.try_element_at(table, (family * 10 + layer).cast("int"))
    kbits = F.get(row, rate_index.cast("int"))
    bit_rate = (kbits * 1000).cast("bigint")
    base = F.get(F.array(*[F.lit(r) for r in SAMPLE_RATES]), sample_index.cast("int"))
    divisor = F.when(version == 25, 4).when(version == 20, 2).otherwise(1)
    sample_rate = F.floor(base / divisor)
    padding = field(word, 9, 1)
    samples = (
        F.when(layer == 1, 384).when((layer == 3) & (version > 10), 576).otherwise(1152)
    )
    layer_one = F.floor(((12 * bit_rate) / sample_rate + padding) * 4)
    others = F.floor((144 * bit_rate) / sample_rate) + padding
    size = F.when(rate_index > 0, F.when(layer == 1, layer_one).otherwise(others))
    out = {
        "version": version.cast("bigint"),
        "layer": layer.cast("bigint"),
        "has_crc": ~has_bit(word, 0x10000),
        "bit_rate": bit_rate,
        "sample_rate": sample_rate.cast("bigint"),
        "padding": padding,
        "channel_mode": field(word, 6, 3),
        "channels": F.when(field(word, 6, 3) == 3, 1).otherwise(2).cast("bigint"),
        "sample_count": samples.cast("bigint"),
        "frame_size": size.cast("bigint"),
    }
    return {"valid": valid} | {n: F.when(valid, c) for n, c in out.items()}
