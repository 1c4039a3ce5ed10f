"""Chats out of event logs: fold the events of a conversation into its final messages, then render them.

A log has one row an event: conv_id, seq, kind, message, role, text. Sorted by seq, events mean

    open        a message begins, with a role; its text is empty, or that of the event
    delta       text is appended to a message
    edit        the text of a message is replaced; so is its role if the event has one
    regenerate  the text of a message is thrown away, and all messages after it with what was streamed into them
    delete      a message goes

``message`` names a message inside its conversation. An event of a message that is not open (never
opened, deleted, or thrown away) changes nothing; opening a message again starts it anew, at the end. Other kinds change nothing.

Logs are partitioned by conversation and sorted by seq in Spark; the fold is one pass over a conversation's events, so the
largest group that a task holds is one conversation, which is one row of the output as well.

Rendered, a turn is its role's opening mark, its text and the closing mark; roles without marks of their own
carry their name. A mark inside a text (or a role) gets one more backslash after its first
character, as do marks that have some there already, so texts hold no marks and come back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import give_back, table

LOG = "conv_id long, seq long, kind string, message long, role string, text string"


@dataclass(frozen=True)
class Template:
    """Marks before and after the text of a role; ``other`` wraps the name of any other role. ``loss`` are the roles that are learned."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>\n"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>\n")})
    other: tuple = ("[ROLE]", "[NAME]", "[/ROLE]\n")
    loss: tuple = ("assistant",)

    def __post_init__(self):
        marks = {m.strip("\n") for ms in self.roles.values() for m in ms} | {m.strip("\n") for m in self.other}
        if any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("a mark has two or more characters and no backslash")
        if any(a.endswith(b[:n]) for a in marks for b in marks for n in range(1, min(len(a), len(b)))):
            raise ValueError("the end of a mark begins another mark: texts could complete it")
        byfirst = "|".join(f"{re.escape(m[0])}(?=\\\\*{re.escape(m[1:])})" for m in sorted(marks))
        undo = "|".join(f"{re.escape(m[0])}\\\\(?=\\\\*{re.escape(m[1:])})" for m in sorted(marks))
        opens = "|".join([*(f"{re.escape(a)}(?s:.*?){re.escape(b)}" for a, b in self.roles.values()), f"{re.escape(self.other[0])}(?s:.*?){re.escape(self.other[2])}"])
        object.__setattr__(self, "_escape", re.compile(byfirst))
        object.__setattr__(self, "_undo", re.compile(undo))
        object.__setattr__(self, "_turn", re.compile(opens))

    def escaped(self, text: str) -> str:
        return self._escape.sub(lambda m: m.group() + "\\", text)

    def restored(self, text: str) -> str:
        return self._undo.sub(lambda m: m.group()[:-1], text)

    def rendered(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation, and where (start, length in code points) its learned texts are."""
        out, at, spans = [], 0, []
        for role, text in messages:
            before, after = self.roles[role] if role in self.roles else (self.other[0] + self.escaped(role) + self.other[1], self.other[2])
            body = self.escaped(text)
            if role in self.loss:
                spans.append((at + len(before), len(body)))
            out += [before, body, after]
            at += len(before) + len(body) + len(after)
        return "".join(out), spans

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """The messages of a formatted conversation."""
        out, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            turn, at = m.group(), m.end()
            for role, (before, after) in self.roles.items():
                if turn.startswith(before):
                    out.append((role, self.restored(turn[len(before) : -len(after)])))
                    break
            else:
                name, text = turn[len(self.other[0]) : -len(self.other[2])].split(self.other[1], 1)
                out.append((self.restored(name), self.restored(text)))
        return out


def folded(events: list[dict]) -> list[tuple[str, str]]:
    """Final (role, text) messages of one conversation's events, which are sorted by seq."""
    open_: dict = {}  # message -> [role, pieces], in order of opening
    for e in events:
        kind, m = e["kind"], e["message"]
        if kind == "open":
            open_.pop(m, None)
            open_[m] = [e["role"] or "", [e["text"] or ""]]
        elif m not in open_:
            continue
        elif kind == "delta":
            open_[m][1].append(e["text"] or "")
        elif kind == "edit":
            open_[m] = [open_[m][0] if e["role"] is None else e["role"], [e["text"] or ""]]
        elif kind == "regenerate":
            open_[m][1] = []
            for later in reversed(list(open_)):
                if later == m:
                    break
                del open_[later]
        elif kind == "delete":
            del open_[m]
    return [(role, "".join(pieces)) for role, pieces in open_.values()]


def formatted(log: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, spans) of every conversation of a log.

    ``spans`` are the places, in code points, of the texts under the loss mask. Null texts and roles are empty; events whose
    seq is null stand first, events of one seq in order of kind, message, role and text, and repeated events count each time;
    null conv_id is a conversation too. A conversation all of whose messages are gone
    has an empty string. An empty log gives an empty table. Other columns are left out.
    """
    template = template or Template()

    def render(logs: pa.Array) -> pa.Array:
        texts, turns, spans = [], [], []
        for i in range(len(logs)):
            messages = folded(logs[i].as_py())
            text, where = template.rendered(messages)
            texts.append(text)
            turns.append(len(messages))
            spans.append([{"start": a, "length": n} for a, n in where])
        give_back()
        return pa.StructArray.from_arrays([pa.array(turns, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64()})))], ["n_turns", "formatted", "spans"])

    drawn = F.arrow_udf(render, "struct<n_turns: long, formatted: string, spans: array<struct<start: long, length: long>>>").asNondeterministic()  # else it runs once for each use
    events = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "message", "role", "text"))).alias("log"))
    out = events.select("conv_id", drawn(F.col("log")).alias("r"))
    return out.select("conv_id", "r.n_turns", "r.formatted", "r.spans")


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, messages, learned, formatted_chars) read from formatted conversations: (role, text) by turn, and the texts that the spans cut out."""
    template = template or Template()

    def read(text: pa.Array, spans: pa.Array) -> pa.Array:
        messages, learned = [], []
        for t, where in zip(text.to_pylist(), spans.to_pylist()):
            messages.append([{"role": r, "text": x} for r, x in template.parsed(t)])
            learned.append([template.restored(t[s["start"] : s["start"] + s["length"]]) for s in where])
        give_back()
        return pa.StructArray.from_arrays([pa.array(messages, pa.list_(pa.struct({"role": pa.string(), "text": pa.string()}))), pa.array(learned, pa.list_(pa.string()))], ["messages", "learned"])

    got = F.arrow_udf(read, "struct<messages: array<struct<role: string, text: string>>, learned: array<string>>").asNondeterministic()
    out = chats.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), got("formatted", "spans").alias("r"))
    return out.select("conv_id", "r.messages", "r.learned", "formatted_chars")


def log_of(rows: DataFrame) -> DataFrame:
    """The log that streams a table of turns (conv_id, turn, role, text): each turn opens a message, then come its lines as deltas.

    Null turns stand first; rows of one turn stand in order of role and text, and each is a message.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = F.regexp_count(text, F.lit("\n")) + 1
    turns = rows.select("conv_id", "role", text.alias("text"), F.row_number().over(in_order).cast("long").alias("message"), (F.sum(lines + 1).over(upto) - lines - 1).alias("before"))
    none = F.lit(None).cast("string")
    begin = F.struct(F.lit("open").alias("kind"), F.col("role").alias("role"), none.alias("text"))
    deltas = F.transform(F.split("text", "(?<=\n)", -1), lambda x: F.struct(F.lit("delta").alias("kind"), none.alias("role"), x.alias("text")))
    steps = turns.select("conv_id", "message", "before", F.posexplode(F.concat(F.array(begin), deltas)).alias("pos", "step"))
    return steps.select("conv_id", (F.col("before") + F.col("pos")).alias("seq"), "step.kind", "message", "step.role", "step.text")


def op12_chat_format(spark, sf_dir) -> DataFrame:
    """All conversations and conversation -7, streamed as a log, folded, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    chats = formatted(log_of(rows.unionByName(own)))
    back = read_back(chats)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
-- the marks and what escaping adds: one backslash for each mark of a text, with or without backslashes inside
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\\\*<SYS>>|<\\\\*</SYS>>|\\[\\\\*INST\\]|\\[\\\\*/INST\\]|<\\\\*s>|<\\\\*/s>|\\[\\\\*ROLE\\]|\\[\\\\*NAME\\]|\\[\\\\*/ROLE\\]'))
          + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 13 WHEN 'assistant' THEN 8 ELSE 20 + length(role) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
