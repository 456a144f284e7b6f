"""Chat formatting: a visitor flattens typed content parts into one marked text per turn, with attachments and loss spans."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import let

FIELDS = {"type": "string", "text": "string", "ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
LEAF = f"struct<{', '.join(f'{n}: {t}' for n, t in FIELDS.items())}>"
#: The parts of a message. A document may hold parts in turn, but no documents.
PARTS = f"array<{LEAF[:-1]}, parts: array<{LEAF}>>>"

#: A control string is ``<`` or ``</``, one of these names, and ``:`` or ``>``.
NAMES = "turn|text|image|audio|document|part"
#: A text that holds one gets one more backslash behind its ``<``, so no control string ever stands in a text.
HELD, HIDDEN = rf"<(\\*)(/?(?:{NAMES})[:>])", rf"<\\(\\*)(/?(?:{NAMES})[:>])"
OPEN, CLOSE, MARK = "<turn:", "</turn>\n", re.compile(r"<(?:text|image|audio|document|part):\d+>|</document>")


def escaped(text: Column) -> Column:
    """The text without control strings; NULL counts as empty. ``restored`` undoes it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(HELD), F.lit(r"<\\$1$2"))


def restored(text: str) -> str:
    return re.sub(HIDDEN, r"<\1\2", text)


def flat(parts: Column) -> Column:
    """All parts in order, those in a document between it and a part of type ``/document``; NULL parts are left out."""

    def spread(part):
        own = F.struct(*(part[n].alias(n) for n in FIELDS))
        inner = F.filter(part["parts"], lambda p: p.isNotNull())
        end = F.struct(*((F.lit("/document") if n == "type" else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()))
        return F.when((part["type"] == "document") & (F.size(inner) > 0), F.concat(F.array(own), inner, F.array(end))).otherwise(F.array(own))

    whole = F.flatten(F.transform(F.filter(parts, lambda p: p.isNotNull()), spread))
    return F.coalesce(whole, F.array().cast(f"array<{LEAF}>"))


class Visitor:
    """What each type of part becomes in the text, and how many tokens it takes in the place of its placeholder.

    An image takes one token for each tile of ``tile`` by ``tile`` pixels, audio ``rate`` tokens a second, a document
    ``page`` tokens a page beside what its parts take; all are rounded up, and unknown sizes take none. A part of any
    other type is an attachment without tokens, and its placeholder is named ``part``.
    """

    def __init__(self, tile: int = 28, rate: float = 25.0, page: int = 1):
        self.tile, self.rate, self.page = tile, rate, page

    def text(self, part: Column, place: Column) -> Column:
        # Two texts in a row are parted, or "<" at the end of one and "/turn>" after it would make a control string.
        mark = F.when(place > 0, F.concat(F.lit("<text:"), place.cast("string"), F.lit(">"))).otherwise("")
        return self._seen(mark, body=escaped(part["text"]))

    def image(self, part: Column, place: Column) -> Column:
        tokens = F.ceil(part["width"] / self.tile) * F.ceil(part["height"] / self.tile)
        return self._attached("image", part, place, tokens)

    def audio(self, part: Column, place: Column) -> Column:
        return self._attached("audio", part, place, F.ceil(part["seconds"] * F.lit(self.rate)))

    def document(self, part: Column, place: Column) -> Column:
        return self._attached("document", part, place, part["pages"] * self.page)

    def document_end(self, part: Column, place: Column) -> Column:
        return self._seen(F.lit("</document>"))

    def other(self, part: Column, place: Column) -> Column:
        return self._attached("part", part, place, F.lit(0))

    def visit(self, part: Column, place: Column) -> Column:
        """(mark, body, attachment) of a part: its control string, its text if it is one, what it refers to otherwise."""
        methods = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document, "/document": self.document_end}
        out = None
        for name, method in methods.items():
            found = part["type"] == name
            out = F.when(found, method(part, place)) if out is None else out.when(found, method(part, place))
        return out.otherwise(self.other(part, place))

    def _attached(self, name: str, part: Column, place: Column, tokens: Column) -> Column:
        mark = F.concat(F.lit(f"<{name}:"), place.cast("string"), F.lit(">"))
        return self._seen(mark, attachment=F.struct(place.cast("int").alias("place"), part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")))

    def _seen(self, mark: Column, body: Column | None = None, attachment: Column | None = None) -> Column:
        body = F.lit(None).cast("string") if body is None else body
        attachment = F.lit(None).cast("struct<place: int, type: string, ref: string, tokens: long>") if attachment is None else attachment
        return F.struct(mark.alias("mark"), body.alias("body"), attachment.alias("attachment"))


def format_turns(turns: DataFrame, *, visitor: Visitor | None = None, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, formatted, loss, attachments, expanded_tokens) for every row of ``turns`` (conv_id, turn, role, and content or text).

    content is an array of parts (``PARTS``); a frame without it has text, which is one part of type text. formatted is
    the marked text of the turn; a conversation is its turns one after another, by turn and formatted. loss are the spans of
    formatted (in code points) that hold texts of the role ``trained``. attachments are the parts that are no text, with
    their place in the message; expanded_tokens is the sum of their tokens. Nothing is shuffled or gathered, so a
    conversation may have any length. NULL text, content, role are empty ones; NULL ids and turns stay and sort first; repeated
    rows are turns of their own. Other columns are left out.
    """
    visitor = visitor or Visitor()
    if "content" in turns.columns:
        parts = flat(F.col("content"))
    else:
        parts = F.array(F.struct(*((F.lit("text") if n == "type" else F.col("text") if n == "text" else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items())))
    role = F.coalesce(F.col("role"), F.lit(""))
    begin = F.concat(F.lit(OPEN), F.url_encode(role), F.lit(">"))
    seen = F.transform(parts, visitor.visit)

    def spans(seen):
        def add(acc, x):
            start = acc["at"] + F.length(x["mark"])
            stop = start + F.coalesce(F.length(x["body"]), F.lit(0))
            span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when((role == trained) & x["body"].isNotNull(), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        start = F.struct(F.length(begin).cast("long").alias("at"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"))
        return F.aggregate(seen, start, add, lambda acc: acc["spans"])

    def row(seen):
        attachments = F.filter(seen["attachment"], lambda a: a.isNotNull())
        texts = F.transform(seen, lambda x: F.concat(x["mark"], F.coalesce(x["body"], F.lit(""))))
        return F.struct(
            F.concat(begin, F.array_join(texts, ""), F.lit(CLOSE)).alias("formatted"),
            spans(seen).alias("loss"),
            attachments.alias("attachments"),
            F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        )

    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), let(seen, row).alias("r")).select("conv_id", "turn", "r.*")


def write(formatted: DataFrame, path: str) -> None:
    """Writes formatted turns with those of a conversation beside each other; a hot conversation is cut at its turns."""
    formatted.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "formatted").write.parquet(path)


def turns_of(formatted: str) -> list[tuple[str, list[str]]]:
    """Role and texts of every turn in a marked text."""
    from urllib.parse import unquote_plus

    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, body = turn.removeprefix(OPEN).partition(">")
        out.append((unquote_plus(role), [restored(t) for t in MARK.split(body)]))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens) for each conversation.

    Reads the marked texts: the first hash is over role, line end, texts, line end of each turn, the second over the
    restored texts below the loss spans. A hash is made turn by turn over rows that Spark has sorted, so a task holds one
    batch of turns, whatever the length of a conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"

    def run(batches):
        key, state, done = None, None, []
        for batch in batches:
            ids, texts, losses, tokens = (batch.column(i).to_pylist() for i in range(4))
            for conv, text, loss, extra in zip(ids, texts, losses, tokens, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(_finished(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, parts in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{''.join(parts)}\n".encode())
                for span in loss:
                    part = restored(text[span["start"] : span["stop"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
                state[5] += extra
            yield _batch(done)
            done = []
        if state is not None:
            yield _batch([_finished(key, state)])

    def _finished(key, state):
        return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.string() if "sha256" in f else pa.int64() for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    rows = formatted.select("conv_id", "formatted", "loss", "expanded_tokens", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.select("conv_id", "formatted", "loss", "expanded_tokens").mapInArrow(run, schema)
