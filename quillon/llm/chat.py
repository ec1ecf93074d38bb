"""Chat formatting: records of any known layout to canonical turns, to text with marked turns and a loss mask.

A record is a JSON string. Its nested field paths, without the kinds of scalars, are hashed to a fingerprint, and the fingerprint selects a
declarative mapping from the record's fields to turns (role, text). A template then writes each turn between control strings; a control
string inside a text is escaped by a backslash after its first character, of which there may be any number, so that no text has a control
string and every text can be read back. In a role, backslashes are doubled besides and the string that ends a head is written \\n. All of it is
Column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh

TURNS = "array<struct<role:string,text:string>>"
#: Parser options: without them strings above 20 million characters can't be read.
LONG_STRINGS = {"maxStringLen": str(2**31 - 1)}
#: Spark parses values up to 128 MB: records up to this size are parsed.
RECORD_BYTES = 100 << 20
#: Turns whose lengths are summed as one part of the mask.
PART = 1024


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that records have (in any order; optional ones may be missing), and where turns come from.

    fields: (role, path) of single turns, in order; or turns: path of an array, with the names of an element's role and text, and renamed
    roles. joined: a path whose text follows the user's after a blank line.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    joined: str = ""

    def variants(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [self.paths]
        for path in self.optional:
            out += [(*v, path) for v in out]
        return [tuple(sorted(v)) for v in out]


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Public layouts of prompts, instructions and messages.
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("prompt", ("prompt", "response"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), joined="input"),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), turns="messages", role="role", text="content", roles=NAMES),
    Mapping("nested messages", ("data", "data.messages", "data.messages[].content", "data.messages[].role"), turns="data.messages", role="role", text="content", roles=NAMES),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=NAMES),
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), turns="turns", role="role", text="text"),
)


def structure_of(variant: Column) -> Column:
    """Nested field paths of a parsed record as one string: Spark's schema of the value, its fields sorted, every kind of scalar as _."""
    return F.regexp_replace(F.schema_of_variant(variant), r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_]+(?:\(\d+(?:,\d+)?\))?", "$1_")


def structure(paths: Sequence[str]) -> str:
    """What structure_of gives for a record with these paths: a.b, and a[].b for fields of an array's elements."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            node = at.setdefault(part.removesuffix("[]"), {"array": False, "below": {}})
            node["array"] |= part.endswith("[]")
            at = node["below"]

    def shown(below: dict) -> str:
        if not below:
            return "_"
        inner = {name: shown(node["below"]) for name, node in below.items()}
        return "OBJECT<" + ", ".join(f"{name}: " + (f"ARRAY<{inner[name]}>" if below[name]["array"] else inner[name]) for name in sorted(below)) + ">"

    return shown(tree)


def fingerprint(of: Column) -> Column:
    return F.sha2(of, 256)


def fingerprints(mapping: Mapping) -> list[str]:
    return [sha256(structure(v).encode()).hexdigest() for v in mapping.variants()]


def mapped_turns(record: Column, mapping: Mapping) -> Column:
    """Canonical turns of a parsed record of the mapping's layout."""
    empty = F.lit("")
    if mapping.fields:
        text_at = lambda path: F.try_variant_get(record, f"$.{path}", "string")
        turns = []
        for role, path in mapping.fields:
            text = text_at(path)
            if role == "user" and mapping.joined:
                extra = F.coalesce(text_at(mapping.joined), empty)
                text = F.when(extra != "", F.concat(F.coalesce(text, empty), F.lit("\n\n"), extra)).otherwise(text)
            turn = F.struct(F.lit(role).alias("role"), F.coalesce(text, empty).alias("text"))
            turns.append(F.when(text.isNotNull(), turn) if role == "system" else turn)
        return F.filter(F.array(*turns), lambda t: t.isNotNull())
    elements = F.try_variant_get(record, f"$.{mapping.turns}", f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>")

    def renamed(role: Column) -> Column:
        for old, new in mapping.roles:
            role = F.when(role == old, new).otherwise(role)
        return F.coalesce(role, empty)

    return F.transform(elements, lambda e: F.struct(renamed(e[mapping.role]).alias("role"), F.coalesce(e[mapping.text], empty).alias("text")))


def canonical(df: DataFrame, record: str, mappings: Sequence[Mapping] = MAPPINGS, given: str | None = None) -> DataFrame:
    """Adds fingerprint, layout and turns.

    A record that isn't JSON, or of a layout without mapping, gets layout NULL and no turns, and stays in the result; so does one above Spark's
    limit for a parsed value (128 MB), unless its turns come typed: where there is a column given (an array of roles and texts) that isn't
    NULL, it is taken as layout "typed".
    """
    parsed, hashed = fresh(df, "__parsed"), fresh(df, "__hashed")
    known = df.withColumn(parsed, F.from_json(F.col(f"`{record}`"), "variant", LONG_STRINGS)).withColumn(hashed, fingerprint(structure_of(F.col(parsed))))
    named, built = F.lit(None).cast("string"), F.array().cast(TURNS)
    for mapping in mappings:
        hit = F.col(hashed).isin(fingerprints(mapping))
        named, built = F.when(hit, mapping.name).otherwise(named), F.when(hit, mapped_turns(F.col(parsed), mapping)).otherwise(built)
    if given:
        typed = F.transform(F.col(f"`{given}`"), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
        named, built = F.when(typed.isNotNull(), "typed").otherwise(named), F.coalesce(typed, built)
    turns = F.coalesce(built, F.array().cast(TURNS))
    return known.withColumns({"fingerprint": F.col(hashed), "layout": named, "turns": turns}).drop(parsed, hashed)


@dataclass(frozen=True)
class Template:
    """start + role + middle + text + end for each turn. controls: further strings that texts mustn't have bare."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        """One more backslash after the first character of each control string."""
        return F.regexp_replace(text, self._whole(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._whole(r"\\(\\*)"), "$1$2$3")

    def escape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.escape(role), F.lit("\\"), F.lit("\\\\")), F.lit(self.middle), F.lit("\\n"))

    def unescape_role(self, role: Column) -> Column:
        """Split at doubled backslashes, what is left of them stands for the middle."""
        pieces = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit(self.middle)))
        return self.unescape(F.array_join(pieces, "\\"))

    def _whole(self, slashes: str) -> str:
        literal = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
        firsts = sorted({c[0] for c in self.controls})
        rests = sorted({c[1:] for c in self.controls}, key=lambda r: (-len(r), r))
        return f"([{''.join(map(literal, firsts))}]){slashes}({'|'.join(map(literal, rests))})"


CHATML = Template()


def format_turns(df: DataFrame, turns: str = "turns", template: Template = CHATML, formatted: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """Adds the formatted text, and the loss mask: its parts (start, end) in code points from 0, each a trained turn's escaped text."""
    first, second = fresh(df, "__written"), fresh(df, "__lengths")
    written = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.concat(F.lit(template.start), template.escape_role(t["role"]), F.lit(template.middle)).alias("head"),
            template.escape(t["text"]).alias("text"),
            t["role"].isin(*template.trained).alias("trained"),
        ),
    )
    size = lambda w: F.char_length(w["head"]) + F.char_length(w["text"]) + F.lit(len(template.end))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("parts"))

    def step(state: Column, w: Column) -> Column:
        begin = state["at"] + w["head_n"]
        part = F.struct(begin.alias("start"), (begin + w["text_n"]).alias("end"))
        return F.struct((state["at"] + w["all_n"]).alias("at"), F.when(w["trained"], F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"))

    lengths = F.transform(
        F.col(first),
        lambda w: F.struct(F.char_length(w["head"]).cast("bigint").alias("head_n"), F.char_length(w["text"]).cast("bigint").alias("text_n"), size(w).cast("bigint").alias("all_n"), w["trained"].alias("trained")),
    )
    out = df.withColumn(first, written).withColumn(second, lengths)
    body = F.array_join(F.transform(F.col(first), lambda w: F.concat(w["head"], w["text"], F.lit(template.end))), "")
    # A list that grows step by step is copied at each step: so in parts, and then the parts' beginnings.
    number = F.greatest(F.ceil(F.size(second) / PART).cast("int"), F.lit(1))
    inner = F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.aggregate(F.slice(second, k * PART + 1, F.lit(PART)), zero, step))
    before = F.aggregate(inner, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    moved = lambda x, o: F.transform(x["parts"], lambda p: F.struct((p["start"] + o).alias("start"), (p["end"] + o).alias("end")))
    parts = F.flatten(F.zip_with(inner, before, moved))
    return out.withColumns({formatted: F.coalesce(body, F.lit("")), mask: F.coalesce(parts, F.array().cast("array<struct<start:bigint,end:bigint>>"))}).drop(first, second)


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Canonical turns from a formatted text: split at the bare control strings, unescaped."""
    literal = "".join(c if c.isalnum() else "\\" + c for c in template.start)
    pieces = F.filter(F.split(formatted, literal), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, template.middle)
        head = F.substring(piece, F.lit(1), cut - 1)
        text = F.substring(piece, cut + len(template.middle), F.char_length(piece) - cut - len(template.middle) + 1 - len(template.end))
        return F.struct(template.unescape_role(head).alias("role"), template.unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, mask: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: template.unescape(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def format_chat(df: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS, template: Template = CHATML, given: str | None = None) -> DataFrame:
    """Adds fingerprint, layout, turns, formatted and loss_mask to records; columns of the same names are replaced.

    NULL texts and roles are empty; repeated records come out alike. Roles and texts of any content can be read back. Columns of layouts that
    rename roles are those of MAPPINGS; the layout "turns" and typed turns keep them.
    """
    return format_turns(canonical(df, record, mappings, given), template=template)


def records(turns: DataFrame) -> DataFrame:
    """(conv_id, record, typed) of a table of turns (conv_id, turn, role, text), rows with the same turn ordered by role and text.

    A user and an assistant row become a prompt record; a system, a user and an assistant row an instruction record; other conversations go
    to messages or to conversations, by whether conv_id is even, or to turns, if a role is one that those two rename. Conversations above
    RECORD_BYTES have no record but typed turns. A conversation is one record, so its rows meet in one task.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    t, roles = F.col("t"), F.transform(F.col("t"), lambda x: x["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    prompt = F.to_json(F.struct(t[0]["text"].alias("prompt"), t[1]["text"].alias("response")))
    instruction = F.to_json(F.struct(t[0]["text"].alias("system"), t[1]["text"].alias("instruction"), t[2]["text"].alias("output")))
    messages = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations")))
    renamed = F.exists(t, lambda x: x["role"].isin(*(old for old, _ in NAMES)))
    kept = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))
    record = F.when(is_("user", "assistant"), prompt).when(is_("system", "user", "assistant"), instruction).when(renamed, kept)
    record = record.when(F.col("conv_id") % 2 == 0, messages).otherwise(shared)
    large = F.octet_length(record) > RECORD_BYTES
    return grouped.select("conv_id", F.when(~large, record).alias("record"), F.when(large, F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("typed"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from formatted and loss_mask alone."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    written = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: A conversation of nothing but control strings.
CONTROL = (-7, "</s>[INST] ok [/INST]")


def with_control(turns: DataFrame) -> DataFrame:
    conv_id, text = CONTROL
    rows = turns.sparkSession.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


_PATTERN = CHATML._whole(r"(\\*)")
SQL = f"""WITH rows AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT {CONTROL[0]}, 0, 'user', '{CONTROL[1]}' UNION ALL SELECT {CONTROL[0]}, 1, 'assistant', '{CONTROL[1]}')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM({len(CHATML.start) + len(CHATML.middle) + len(CHATML.end)} + length(replace(replace(regexp_replace(role, '{_PATTERN}', '\\1\\\\\\2\\3', 'g'), '\\', '\\\\'), chr(10), '\\n')) + length(regexp_replace(text, '{_PATTERN}', '\\1\\\\\\2\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""
