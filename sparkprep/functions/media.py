"""Column expressions for media records and diffusion training: placeholders, grids, geometry, time steps and masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkprep.functions.arrays import runs
from sparkprep.functions.text import placeholder_parts


def grid_size(frames: Column, height: Column, width: Column, patch: tuple[int, int, int]) -> Column:
    """array<long>: patches along time, height and width."""
    return F.array(*(F.floor(x / p).cast("long") for x, p in zip((frames, height, width), patch)))


def placeholder_count(frames: Column, height: Column, width: Column, merge: int) -> Column:
    """Tokens that a placeholder of a t x h x w grid expands to when merge x merge patches share one."""
    return (frames * F.floor(height / merge) * F.floor(width / merge)).cast("long")


def adjusted_runs(ids: Column, sizes: Column, start: int, end: int, *others: Column) -> list[Column]:
    """``ids``, and ``others`` of the same length, with the k-th run of media tokens between ``start`` and ``end`` made to fit ``sizes``[k].

    A run grows by copies behind its start mark if the size is over the run's length with its marks; it shrinks to its first
    tokens if the size is under that. Copies stand in the other arrays too. A run has a token at least; runs beyond ``sizes`` stay.
    """
    places = F.transform(F.array(F.struct(ids.alias("x"), sizes.alias("n"))), lambda v: F.struct(
        v["x"].alias("x"), v["n"].alias("n"),
        *(F.filter(F.transform(v["x"], lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull()).alias(name) for name, mark in (("a", start), ("b", end))),
    ))
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    copied = lambda at: F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(None).cast("long").alias("token")))

    def run(v: Column, k: Column) -> Column:
        a, b, n = F.get(v["a"], k), F.get(v["b"], k), F.get(v["n"], k).cast("int")
        before = F.when(k > 0, F.get(v["b"], k - 1)).otherwise(0)
        token, held = F.get(v["x"], a + 1), b - a + 1
        inside = span(a + 1, b - 1)
        media = F.filter(inside, lambda i: F.get(v["x"], i) == token)
        last = F.coalesce(F.get(media, n - 1), b)
        kept = F.when(n == 0, F.filter(inside, lambda i: F.get(v["x"], i) != token)).when(n < held, F.filter(inside, lambda i: (i <= last) | (F.get(v["x"], i) != token))).otherwise(inside)
        more = F.array_repeat(F.struct(F.lit(None).cast("int").alias("at"), token.cast("long").alias("token")), F.when(n > held, n + 2 - held).otherwise(0))
        return F.concat(copied(span(before, a)), more, copied(kept))

    def whole(v: Column) -> Column:
        runs = F.least(F.size(v["n"]), F.size(v["a"]), F.size(v["b"]))
        body = F.flatten(F.transform(span(F.lit(0), runs - 1), lambda k: run(v, k)))
        return F.concat(body, copied(span(F.when(runs > 0, F.get(v["b"], runs - 1)).otherwise(0), F.size(v["x"]) - 1)))

    steps = F.transform(places, whole)[0]
    return [F.transform(F.array(F.struct(x.alias("x"), steps.alias("s"))), lambda v: F.transform(v["s"], lambda p: F.coalesce(F.get(v["x"], p["at"]).cast("long"), p["token"])))[0] for x in (ids, *others)]


def grid_positions(frames: int, height: int, width: int, offset: Column) -> Column:
    """array<struct<t, h, w>>: the places of a grid from ``offset`` on, time slowest."""
    places = F.sequence(F.lit(0), F.lit(frames * height * width - 1))
    return F.transform(places, lambda i: F.struct((F.floor(i / (height * width)) + offset).cast("long").alias("t"), (F.floor(i / width) % height + offset).cast("long").alias("h"), (i % width + offset).cast("long").alias("w")))


def mask_positions(mask: Column) -> Column:
    """Position ids by the running sum of a mask of 0 and 1, less one."""
    ones = lambda m: F.filter(F.transform(m, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    # From each 1 to the next, positions are the same.
    spread = lambda v: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.coalesce(F.get(v["at"], F.lit(0)), v["n"])),
        F.flatten(F.transform(v["at"], lambda p, k: F.array_repeat(k.cast("long"), F.coalesce(F.get(v["at"], k + 1), v["n"]) - p))),
    )
    return F.transform(F.array(F.struct(ones(mask).alias("at"), F.size(mask).alias("n"))), spread)[0]


def fitted(width: Column, height: Column, box_width: int, box_height: int, fill: bool = False) -> tuple[Column, Column]:
    """(width, height) that fit in a box, or fill it, with the aspect kept; cut to whole pixels."""
    aspect = width / F.greatest(height, F.lit(1))
    by_width = (aspect > box_width / max(1, box_height)) != F.lit(fill)
    w = F.when(by_width, box_width).otherwise(F.floor(box_height * aspect)).cast("long")
    h = F.when(by_width, F.floor(box_width / aspect)).otherwise(box_height).cast("long")
    return w, h


def mixed_positions(ids: Column, image: int, video: int, images: Column, videos: Column, merge: int = 2) -> Column:
    """array<struct<t, h, w>> over the tokens of text with media: text counts on in all three, a grid's places start behind it.

    ``images`` and ``videos`` are array<struct<t, h, w>> of grids before ``merge`` x ``merge`` places share a token; a video's frames
    stand apart, each with a grid of its own. The counting goes on behind the largest place of a grid.
    """
    frames = F.flatten(F.transform(videos, lambda g: F.array_repeat(F.struct(F.lit(1).alias("t"), g["h"].cast("int").alias("h"), g["w"].cast("int").alias("w")), g["t"].cast("int"))))
    grids = F.transform(images, lambda g: F.struct(g["t"].cast("int").alias("t"), g["h"].cast("int").alias("h"), g["w"].cast("int").alias("w")))
    point = lambda t, h, w: F.struct(t.cast("long").alias("t"), h.cast("long").alias("h"), w.cast("long").alias("w"))
    empty = F.array().cast("array<struct<from: int, to: int, base: bigint, t: int, h: int, w: int>>")

    # Each run of media becomes a piece: where it begins and ends among the tokens, and the position that it starts from.
    def step(s: Column, x: Column) -> Column:
        media = (x == image) | (x == video)
        begins = media & (s["i"] >= s["until"])
        g = F.when(x == image, F.get(s["images"], s["ni"])).otherwise(F.get(s["frames"], s["nv"]))
        t, h, w = g["t"], F.floor(g["h"] / merge).cast("int"), F.floor(g["w"] / merge).cast("int")
        piece = F.struct(s["i"].alias("from"), (s["i"] + t * h * w).alias("to"), s["next"].alias("base"), t.alias("t"), h.alias("h"), w.alias("w"))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(begins, s["i"] + t * h * w).otherwise(s["until"]).cast("int").alias("until"),
            F.when(begins, s["next"] + F.greatest(t, h, w)).when(s["i"] >= s["until"], s["next"] + 1).otherwise(s["next"]).cast("long").alias("next"),
            F.when(begins & (x == image), s["ni"] + 1).otherwise(s["ni"]).alias("ni"),
            F.when(begins & (x == video), s["nv"] + 1).otherwise(s["nv"]).alias("nv"),
            s["images"].alias("images"),
            s["frames"].alias("frames"),
            F.when(begins, F.concat(s["pieces"], F.array(piece))).otherwise(s["pieces"]).alias("pieces"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("until"), F.lit(0).cast("long").alias("next"), F.lit(0).alias("ni"), F.lit(0).alias("nv"), grids.alias("images"), frames.alias("frames"), empty.alias("pieces"))
    pieces = F.aggregate(ids, start, step, lambda s: s["pieces"])
    text = lambda a, b, base: F.when(b > a, F.transform(F.sequence(F.lit(0), b - a - 1), lambda k: point(base + k, base + k, base + k))).otherwise(F.array().cast("array<struct<t: bigint, h: bigint, w: bigint>>"))
    grid = lambda p: F.transform(F.sequence(F.lit(0), p["t"] * p["h"] * p["w"] - 1), lambda k: point(p["base"] + F.floor(k / (p["h"] * p["w"])), p["base"] + F.floor(k / p["w"]) % p["h"], p["base"] + k % p["w"]))

    def whole(v: Column) -> Column:
        ps, n = v["p"], v["n"]
        ended = lambda k: F.when(k > 0, F.get(ps, k - 1)["to"]).otherwise(0)
        placed = F.transform(ps, lambda p, k: F.concat(text(ended(k), p["from"], p["base"] - (p["from"] - ended(k))), grid(p)))
        last = F.get(ps, F.size(ps) - 1)
        behind = F.when(F.size(ps) > 0, last["base"] + F.greatest(last["t"], last["h"], last["w"])).otherwise(0)
        return F.concat(F.flatten(placed), text(ended(F.size(ps)), n, behind))

    return F.transform(F.array(F.struct(pieces.alias("p"), F.size(ids).alias("n"))), whole)[0]


def truncation_repaired(ids: Column, labels: Column, mask: Column, media: int, size: int, pad: int) -> dict[str, Column]:
    """ids, labels and mask cut to ``size``; a run of media tokens that the cut goes through becomes padding, and ``complete`` counts the others."""
    blocks = F.filter(runs(ids), lambda r: r["value"] == media)
    broken = F.filter(blocks, lambda r: (r["end"] > size) & (r["start"] < size))
    at = F.coalesce(F.get(broken, F.lit(0))["start"], F.lit(size).cast("long"))
    cut = lambda a, value: F.transform(F.array(F.struct(F.slice(a, 1, size).alias("a"), at.alias("at"))), lambda v: F.transform(v["a"], lambda x, i: F.when(i >= v["at"], F.lit(value).cast("long")).otherwise(x)))[0]
    return {"input_ids": cut(ids, pad), "labels": cut(labels, -100), "loss_mask": cut(mask, 0), "complete": F.size(F.filter(blocks, lambda r: r["end"] <= size)).cast("long")}


def placed_media(text: Column, images: Column, videos: Column) -> Column:
    """array<struct<type, value>>: a text cut at <image> and <video>, the k-th mark replaced by the k-th medium of its kind; marks without one go."""
    marks = ("<image>", "<video>")
    parts = placeholder_parts(text, marks)
    nth = lambda ps, i, mark: F.size(F.filter(F.slice(ps, F.lit(1), i), lambda x: x == mark))  # noqa: E731  # marks of a record are few
    value = lambda ps, x, i: F.when(x == "<image>", F.get(images, nth(ps, i, "<image>"))).when(x == "<video>", F.get(videos, nth(ps, i, "<video>"))).otherwise(x)
    kind = lambda x: F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text")
    made = F.transform(F.array(parts), lambda ps: F.transform(ps, lambda x, i: F.struct(kind(x).alias("type"), value(ps, x, i).alias("value"))))[0]
    return F.filter(made, lambda p: p["value"].isNotNull())


def decoder_kind(name: Column) -> Column:
    """What decodes an archive's member, by its extension: image, video, audio, or raw."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    kinds = {"image": ("jpg", "jpeg", "png", "ppm", "pgm", "pbm", "pnm", "webp"), "video": ("videos", "jpgs", "mp4", "avi", "mov", "webm", "mkv"), "audio": ("wav", "wavs", "mp3", "flac")}
    out = F.lit("raw")
    for kind, names in kinds.items():
        out = F.when(extension.isin(*names), kind).otherwise(out)
    return out


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) by a keyed hash: the first 32 bits of an MD5."""
    text = F.concat_ws("-", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def normal(*parts: Column | int | str) -> Column:
    """A number of the standard normal distribution by a keyed hash: two uniform ones by the polar form."""
    u, v = uniform(*parts, "u"), uniform(*parts, "v")
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(2.0**-33)))) * F.cos(2 * math.pi * v)


def drawn_noise(kind: str, key: Column, seed: int = 0, mean: float = 0.0, deviation: float = 1.0, mode_scale: float = 1.29) -> Column:
    """A number in [0, 1] from one of the distributions that noise levels are drawn from: uniform, logit_normal, lognorm, mix or mode."""
    if kind in ("logit_normal", "lognorm", "mix"):
        z = normal(key, seed)
        return 1 / (1 + F.exp(-(z * deviation + mean if kind == "logit_normal" else z)))
    u = uniform(key, seed)
    if kind == "mode":
        u = 1 - u - mode_scale * (F.pow(F.cos(math.pi * u / 2), 2) - 1 + u)
        return F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    return u


def noise_level(kind: str, key: Column, seed: int = 0, shift: float = 1.0, low: float = 0.0, high: float = 1.0, uniform_share: float = 0.0, steps: int = 1000, **options: float) -> tuple[Column, Column]:
    """(sigma, time step): a drawn number shifted and kept within bounds. With ``uniform_share`` a draw is uniform that often."""
    u = drawn_noise(kind, key, seed, **options)
    if kind != "uniform" and uniform_share > 0:
        u = F.when(uniform(key, seed, "mix") < uniform_share, uniform(key, seed)).otherwise(u)
    sigma = F.least(F.greatest(shift / (shift + (1 / F.greatest(u, F.lit(1e-5)) - 1)), F.lit(low)), F.lit(high))
    return sigma, sigma * steps


def time_step(u: Column, shift: float = 1.0, low: float = 0.0, high: float = 1.0) -> Column:
    """A noise level from a uniform number: shift / (shift + 1 / u - 1), kept within bounds."""
    return F.least(F.greatest(F.when(u > 0, shift / (shift + 1 / u - 1)).otherwise(0.0), F.lit(low)), F.lit(high))


def masked_at_random(ids: Column, key: Column, token: int, mask: Column | None = None, least: float = 1e-3, seed: int = 0) -> dict[str, Column]:
    """input_ids with tokens replaced by ``token``, which ones, and the chance: one chance for each row, drawn from ``least`` to 1.

    Places whose mask is 0 are never replaced.
    """
    chance = (1 - least) * uniform(key, seed, "t") + least
    hit = F.transform(ids, lambda _, i: uniform(key, seed, i) < chance)
    hit = hit if mask is None else F.zip_with(hit, mask, lambda h, m: h & (m != 0))
    return {"input_ids": F.zip_with(ids, hit, lambda x, h: F.when(h, F.lit(token).cast("long")).otherwise(x)), "masked": hit, "chance": chance}


def interpolated(clean: Column, noise: Column, sigma: Column) -> Column:
    return F.zip_with(clean, noise, lambda a, b: (1 - sigma) * a + sigma * b)


def weighted_error(a: Column, b: Column, weight: Column) -> Column:
    """Weighted mean of the squared differences."""
    return weight * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def block_visible(query: Column, key: Column, n: int, block: int) -> Column:
    """Whether a place sees another in block diffusion: places 0 to n-1 are noisy, n to 2n-1 clean.

    A noisy block sees itself and the clean blocks before it; a clean place sees the clean places up to itself.
    """
    noisy_q, noisy_k = query < n, key < n
    block_q, block_k = F.floor(query % n / block), F.floor(key % n / block)
    return (noisy_q & noisy_k & (block_q == block_k)) | (noisy_q & ~noisy_k & (block_k < block_q)) | (~noisy_q & ~noisy_k & (key <= query))


def media_message(text: Column, images: Column, marks: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """array<struct<type, value>>: media first, then the text without its placeholders as one part."""
    bare = text
    for mark in marks:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return F.concat(F.transform(images, lambda x: F.struct(F.lit("image").alias("type"), x.alias("value"))), F.array(F.struct(F.lit("text").alias("type"), F.trim(bare).alias("value"))))


def consistent_media(text: Column, media: Column, mark: str = "<image>") -> Column:
    """Whether a text has as many placeholders as there are media, and any at all."""
    return (F.size(media) > 0) & (F.regexp_count(text, F.lit(mark)) == F.size(media))


def media_prefix(ids: Column, token: int, copies: int, room: int, pad: int) -> tuple[Column, Column]:
    """(input_ids, labels): placeholder copies, then the text cut to the room left, padded; labels of copies, padding and the last place are ignored."""
    front = F.array_repeat(F.lit(token).cast("long"), copies)
    text = F.slice(ids, 1, max(room - copies, 0))
    whole = F.concat(front, text, F.array_repeat(F.lit(pad).cast("long"), room - copies - F.size(text)))
    end = copies + F.size(text)
    nxt = F.transform(whole, lambda _, i: F.when((i + 1 < end) & (i + 1 >= copies), F.try_element_at(whole, (i + 2).cast("int"))).otherwise(F.lit(-100).cast("long")))
    return whole, nxt


def lettered(options: Column) -> Column:
    """Answer options as lines A. ..., B. ..., by the characters from A on."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


def padded_vectors(vectors: Column, size: int) -> Column:
    """array<array<double>> cut to ``size`` vectors, or with vectors of zeros behind until there are so many."""
    zeros = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    return F.concat(F.slice(vectors, 1, size), F.array_repeat(zeros, F.greatest(F.lit(size) - F.size(vectors), F.lit(0))))
