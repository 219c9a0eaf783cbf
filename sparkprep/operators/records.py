"""Training records: field truncation, example assembly, chat turns, conversations and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.text import template_parts

SPLIT_NAMES = {"training": "train", "val": "validation", "valid": "validation", "eval": "validation", "testing": "test"}


def split_name(name: Column) -> Column:
    """The standard name of a split: the part before a bracket or slice, aliases resolved."""
    base = F.lower(F.trim(F.regexp_extract(name, r"^([A-Za-z]+)", 1)))
    out = base
    for alias, standard in SPLIT_NAMES.items():
        out = F.when(base == alias, standard).otherwise(out)
    return out


def truncated_fields(sizes: dict[str, Column], overflow: Column) -> dict[str, Column]:
    """How many tokens each field keeps when ``overflow`` tokens must go: an even share each, the first fields one more for
    the remainder, none below zero."""
    n = len(sizes)
    over = F.greatest(overflow, F.lit(0))
    return {name: F.greatest(size - F.floor(over / n) - (F.lit(i) < over % n).cast("long"), F.lit(0)).cast("long") for i, (name, size) in enumerate(sizes.items())}


def truncated_parts(parts: list[tuple[str | None, Column]], fields: list[str], most: int, answer_room: int = 0, extra: int = 0, side: str = "right") -> list[Column]:
    """The parts of a prompt cut so that all fit in ``most`` tokens: (field or None, tokens) in order, the answer last.

    Counted are the parts, ``extra`` marks, and for the answer at least ``answer_room``. What is over is shared by the ``fields``,
    the first ones taking the remainder; what they are too short for is taken from the parts one after the other, from the
    first on for ``left``, from the last on for ``right``, which leaves room for the answer as well.
    """
    if side not in ("left", "right"):
        raise ValueError(f"parts are cut at their left or right, not {side}")
    sizes = [F.size(x) for _, x in parts]
    answer = sizes[-1]
    total = sum(sizes[:-1], F.lit(extra)) + F.greatest(answer, F.lit(answer_room))
    over = F.greatest(total - most, F.lit(0))
    own = [i for i, (name, _) in enumerate(parts) if name in fields]
    rest = over
    for k, i in enumerate(own):
        share = F.floor(over / len(own)).cast("int") + (F.lit(k) < over % len(own)).cast("int")
        cut = F.least(sizes[i], share)
        sizes[i], rest = sizes[i] - cut, rest - cut
    if side == "right":
        rest = F.when(rest > 0, rest + F.least(answer, F.lit(answer_room))).otherwise(0)
    for i in range(len(parts)) if side == "left" else reversed(range(len(parts))):
        cut = F.least(sizes[i], F.greatest(rest, F.lit(0)))
        sizes[i], rest = sizes[i] - cut, rest - cut
    first = lambda x, n: F.slice(x, F.lit(1), n) if side == "right" else F.slice(x, F.size(x) - n + 1, n)
    return [F.when(n > 0, first(x, F.greatest(n, F.lit(1)))).otherwise(F.slice(x, 1, 0)) for (_, x), n in zip(parts, sizes)]


def assembled(context: Column, answer: Column, bos: int | None, sep: int | None, eos: int | None, virtual: int = 0, virtual_id: int | None = None) -> dict[str, Column]:
    """input_ids, answer_start and loss_mask of a context and its answer with their marks.

    ``virtual`` places for tokens that are learnt stand before the context, filled with ``virtual_id`` or the end mark.
    """
    one = lambda x: F.array(F.lit(x).cast("long")) if x is not None else F.array().cast("array<bigint>")
    places = F.array_repeat(F.lit(eos if virtual_id is None else virtual_id).cast("long"), virtual) if virtual else one(None)
    # The parts are bound once: an expression named within a lambda would be worked out again for each token.
    parts = F.struct(F.concat(one(bos), places, context, one(sep)).alias("front"), F.concat(answer, one(eos)).alias("back"))
    start = lambda v: F.size(v["front"]).cast("long")
    mask = lambda v: F.concat(F.array_repeat(F.lit(0).cast("long"), F.size(v["front"])), F.array_repeat(F.lit(1).cast("long"), F.size(v["back"])))
    made = F.transform(F.array(parts), lambda v: F.struct(F.concat(v["front"], v["back"]).alias("input_ids"), start(v).alias("answer_start"), mask(v).alias("loss_mask")))[0]
    return {name: made[name] for name in ("input_ids", "answer_start", "loss_mask")}


def prompt_examples(rows: DataFrame, template: str, tokenize: Callable[[Column], Column], most: int, fields: list[str], label: str = "label", bos: int | None = None, sep: int | None = None, eos: int | None = None, virtual: int = 0, answer_room: int = 0, side: str = "right") -> DataFrame:
    """(input_ids, answer_start_idx, context_ids, context_length, answer_ids, token_count, metadata) of records under a template.

    The template's parts are tokenized, cut (``truncated_parts``) and put together; columns that it doesn't name are the metadata.
    """
    if not set(fields) <= {name for kind, name in template_parts(template, label=label) if kind == "field"}:
        raise ValueError(f"the template has no fields {fields}")
    parts = [(name if kind == "field" else None, tokenize(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if kind == "field" else F.lit(name))) for kind, name in template_parts(template, label=label)]
    named = [name for kind, name in template_parts(template, label=label) if kind == "field"]
    other = [c for c in rows.columns if c not in named]
    tokens = rows.select(F.struct(*other).alias("metadata") if other else F.lit(None).alias("metadata"), *(x.alias(f"p{i}") for i, (_, x) in enumerate(parts)))
    marks = virtual + sum(x is not None for x in (bos, sep, eos))
    cut = truncated_parts([(name, F.col(f"p{i}")) for i, (name, _) in enumerate(parts)], fields, most, answer_room, marks, side)
    held = tokens.select("metadata", F.concat(F.array().cast("array<bigint>"), *cut[:-1]).alias("c"), cut[-1].alias("answer_ids"))
    made = assembled(F.col("c"), F.col("answer_ids"), bos, sep, eos, virtual)
    whole = held.select(made["input_ids"].alias("input_ids"), made["answer_start"].alias("answer_start_idx"), "answer_ids", "metadata")
    context = F.slice("input_ids", F.lit(1), F.col("answer_start_idx").cast("int"))
    return whole.select("input_ids", "answer_start_idx", context.alias("context_ids"), F.col("answer_start_idx").alias("context_length"), "answer_ids", F.size("input_ids").cast("long").alias("token_count"), "metadata")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order as array<struct<role, content>>."""
    held = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(held.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(F.lower(x["role"]).alias("role"), x["text"].alias("content"))).alias("messages"))


def chatml_roles(messages: Column) -> Column:
    """Roles by place: an odd number of turns begins with the system; then user and assistant in turn."""
    odd = F.size(messages) % 2
    return F.transform(messages, lambda x, i: F.struct(F.when((odd == 1) & (i == 0), "system").when((i - odd) % 2 == 0, "user").otherwise("assistant").alias("role"), x["content"].alias("content")))


def rendered_chat(messages: Column, start: str = "<|turn|>", end_name: str = "\n", end: str = "<|end|>\n") -> Column:
    """One text with a mark before each speaker, behind their name and behind their turn."""
    return F.array_join(F.transform(messages, lambda x: F.concat(F.lit(start), x["role"], F.lit(end_name), F.coalesce(x["content"], F.lit("")), F.lit(end))), "")


def role_mask(messages: Column, role: str = "assistant") -> Column:
    """For each word of the turns in order, 1 if ``role`` says it."""
    return F.flatten(F.transform(messages, lambda x: F.transform(F.split(F.coalesce(x["content"], F.lit("")), " ", -1), lambda _: (x["role"] == role).cast("long"))))


def answer_split(mask: Column) -> Column:
    """Where the last answer begins: behind the last 0 of the mask."""
    places = F.filter(F.transform(mask, lambda m, i: F.when(m == 0, i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(places), F.lit(0)).cast("long")


def role_text(messages: Column, role: str = "assistant", joiner: str = " ") -> Column:
    """The texts of one role, joined."""
    return F.array_join(F.transform(F.filter(messages, lambda x: x["role"] == role), lambda x: F.coalesce(x["content"], F.lit(""))), joiner)


def user_assistant_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, input, output): each user turn followed by an assistant turn."""
    user = turns.where(F.lower("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    reply = turns.where(F.lower("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"])


def fill_in_the_middle(text: Column, key: Column, rate_hex: str = "80", form: str = "psm", marks: tuple[str, str, str] = ("<pre>", "<suf>", "<mid>")) -> Column:
    """The text permuted for infilling, with a chance of rate_hex / 256 drawn by a keyed hash; two cuts from the same hash.

    ``psm`` puts prefix, suffix, middle; ``spm`` suffix and prefix first. Texts that aren't drawn stay.
    """
    draw = F.md5(F.concat_ws("-", key.cast("string"), F.lit("fim")))
    n = F.length(text)
    place = lambda at: F.pmod(F.conv(F.substring(draw, at, 8), 16, 10).cast("long"), n + 1)
    low, high = F.least(place(3), place(11)), F.greatest(place(3), place(11))
    prefix = F.substring(text, F.lit(1), low.cast("int"))
    middle = F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))
    suffix = F.substring(text, (high + 1).cast("int"), n)
    pre, suf, mid = map(F.lit, marks)
    moved = F.concat(pre, prefix, suf, suffix, mid, middle) if form == "psm" else F.concat(pre, suf, suffix, mid, prefix, middle)
    return F.when(F.substring(draw, 1, 2) < rate_hex, moved).otherwise(text)


def infilled_tokens(ids: Column, key: Column, end: int, pad: int, permute: Callable[[Column, Column], Column], fragment: int | None = None, whole_rate_hex: str = "80") -> Column:
    """A sample's documents, which ``end`` tokens part, each permuted by itself, and the sample cut or padded to the length it had.

    ``permute`` makes a permuted piece from (tokens, key). With ``fragment``, a document with such tokens is left as it is or, by a
    keyed draw, permuted piece by piece between them.
    """
    # Empty documents between two ends go, with their ends.
    def pieces(a: Column, mark: int) -> Column:
        ends = F.concat(F.filter(F.transform(a, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull()), F.array(F.size(a)))
        spans = F.transform(F.array(ends), lambda e: F.transform(e, lambda b, k: F.struct(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0).alias("a"), b.alias("b"), (k == F.size(e) - 1).alias("last"))))[0]
        return F.filter(spans, lambda s: s["last"] | (s["b"] > s["a"]))

    def joined(a: Column, mark: int, made: Callable[[Column, Column], Column]) -> Column:
        one = lambda s, k: F.concat(made(F.slice(a, s["a"] + 1, s["b"] - s["a"]), k), F.when(s["last"], F.array().cast("array<bigint>")).otherwise(F.array(F.lit(mark).cast("long"))))
        return F.flatten(F.transform(pieces(a, mark), one))

    def document(x: Column, k: Column) -> Column:
        own = F.concat_ws("-", key.cast("string"), k.cast("string"))
        if fragment is None:
            return permute(x, own)
        drawn = F.substring(F.md5(F.concat_ws("-", own, F.lit("fragments"))), 1, 2) < whole_rate_hex
        split = joined(x, fragment, lambda y, j: permute(y, F.concat_ws("-", own, j.cast("string"))))
        return F.when(~F.array_contains(x, F.lit(fragment).cast("long")), permute(x, own)).when(drawn, split).otherwise(x)

    made = joined(ids, end, document)
    fitted = lambda x: F.concat(F.slice(x, F.lit(1), F.size(ids)), F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.size(ids) - F.size(x), F.lit(0))))
    return F.transform(F.array(made), fitted)[0]


def existing_media(rows: DataFrame, media: DataFrame, key: str, needs: dict[str, Column]) -> DataFrame:
    """Rows whose needed media all exist: ``needs`` names for each kind whether a row needs it; media has (key, kind)."""
    held = media.groupBy(key).agg(F.collect_set("kind").alias("kinds"))
    joined = rows.join(held, key, "left")
    fits = F.lit(True)
    for kind, needed in needs.items():
        fits = fits & (~needed | F.coalesce(F.array_contains("kinds", kind), F.lit(False)))
    return joined.where(fits).drop("kinds")
