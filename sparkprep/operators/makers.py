"""Makers of conversations from rows of known datasets: images, several images, audio and speech.

A conversation is array<struct<role, content>>, and content array<struct<type, value>>: the same for every maker, so their
results can be put together by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))


def exchange(asked: list[Column], answer: Column) -> Column:
    """One turn of the user with its parts, and one of the assistant with a text."""
    turn = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    return F.array(turn("user", F.array(*asked)), turn("assistant", F.array(part("text", answer))))


def described_image(image: Column, text: Column, prompt: str = "Describe this image.") -> Column:
    """A picture and what it shows."""
    return exchange([part("image", image), part("text", F.lit(prompt))], text)


def asked_image(image: Column, question: Column, answer: Column) -> Column:
    """A picture, a question about it and the answer, as in medical question answering."""
    return exchange([part("image", image), part("text", question)], answer)


def several_images(rows: DataFrame, images: str, texts: str, split: str = "train") -> DataFrame:
    """Adds ``conversation``: all images, then the first text's user prompt; its assistant answers.

    ``texts`` is array<struct<user, assistant>>. Rows without images, texts, prompt or answer go. There is a training split only.
    """
    if split != "train":
        raise ValueError("this kind of record has a training split only")
    first = F.get(F.col(texts), F.lit(0))
    asked = F.concat(F.transform(images, lambda x: part("image", x)), F.array(part("text", first["user"])))
    turn = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    whole = F.array(turn("user", asked), turn("assistant", F.array(part("text", first["assistant"]))))
    return rows.where((F.size(images) > 0) & (F.size(texts) > 0) & first["user"].isNotNull() & first["assistant"].isNotNull()).withColumn("conversation", whole)


def transcribed_audio(rows: DataFrame, audio: str, text: str, prompt: str = "Transcribe the audio clip.", remove_spaces: bool = True) -> DataFrame:
    """(conversation, audio): the two columns of a clip and its transcript alone; spaces of the transcript go unless told otherwise."""
    said = F.replace(text, F.lit(" "), F.lit("")) if remove_spaces else F.col(text)
    return rows.select(exchange([part("audio", F.lit("placeholder")), part("text", F.lit(prompt))], said).alias("conversation"), F.col(audio).alias("audio"))


def mono(samples: Column) -> Column:
    """The mean over the channels of array<array<double>>: samples in time, channels within."""
    return F.transform(samples, lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def spoken(rows: DataFrame, samples: str, rate: str, text: str, prompt: str) -> DataFrame:
    """(conversation, audio): decoded speech, several channels as their mean, with its sampling rate; a row without samples is an error."""
    kind = rows.schema[samples].dataType.simpleString()
    wave = mono(F.col(samples)) if kind.startswith("array<array") else F.col(samples)
    held = F.when(F.col(samples).isNotNull(), wave).otherwise(F.raise_error("a clip has no samples").cast("array<double>"))
    return rows.select(exchange([part("text", F.concat(F.lit("<|audio_1|>"), F.lit(prompt)))], F.col(text)).alias("conversation"), F.struct(held.alias("samples"), F.col(rate).alias("rate")).alias("audio"))


#: Makers of conversations by the short names that configurations use.
ALIASES = {"described": described_image, "medical": asked_image, "several": several_images, "audio": transcribed_audio, "speech": spoken}


def maker(name: str):
    """A maker by its short name; an unknown one is an error that lists those there are."""
    if name not in ALIASES:
        raise ValueError(f"no maker {name}; there are {sorted(ALIASES)}")
    return ALIASES[name]
