"""Quality rules: every rule is evaluated once into a ledger of failure bits; policies and ablations only read the ledger."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orefield.llm.shared import bounded_batches
from orefield.llm.textnum import SPACE, Stretches, buffers, mix, runs

#: Bytes that count as symbols, and bytes of letters in ASCII.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: First bytes of code points, and those of letters: ASCII letters and all beyond ASCII.
POINT = np.ones(256, bool)
POINT[0x80:0xC0] = False
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[0xC0:] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_word_letters", "n_marks_only"]
c = F.col


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, a condition on the measurements, holds; its bit is the rule's place in RULES."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """New rules go to the end, so that bits in older ledgers keep their meaning."""
    return [
        Rule("few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("shouting", 100 * c("n_upper") > 40 * c("n_letters")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 14 * c("n_words")),
        Rule("few_letters", 100 * c("n_word_letters") < 60 * c("word_chars")),
        Rule("bare_marks", 100 * c("n_marks_only") > 20 * c("n_words")),
    ]


@dataclass(frozen=True)
class Policy:
    """Keeps a document that fails at most ``allowed`` of the named rules, and none of the ``fatal`` ones."""

    name: str
    version: int
    fatal: tuple[str, ...]
    named: tuple[str, ...] = ()
    allowed: int = 0


#: Versions are added, never changed: a verdict can be told from a ledger and a policy's name and version.
POLICIES = [
    Policy("base", 1, ("few_words", "repeated_windows")),
    Policy("lenient", 1, ("few_words", "repeated_windows"), ("symbols", "shouting", "duplicate_lines", "short_words", "long_words", "few_letters", "bare_marks"), 1),
    Policy("strict", 1, ("few_words", "repeated_windows", "symbols", "shouting", "duplicate_lines", "short_words", "long_words", "few_letters", "bare_marks")),
]
BASE, LENIENT, STRICT = POLICIES


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _again(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there another of the same key in its row, is it a later one of them)."""
    key = mix(key + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.concatenate(([False], same)) if len(key) else np.zeros(0, bool)
    any_ = later | np.concatenate((same, [False])) if len(key) else later
    out = np.empty((2, len(key)), bool)
    out[:, order] = any_, later
    return out[0], out[1]


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MEASURES of each text of a buffer; words and lines are told apart by 64-bit hashes within their own text."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(n, np.int64)] * len(MEASURES)
    of = lambda rows, flags=None: np.bincount(rows, flags, n).astype(np.int64)
    text, point, letter = SPACE[data] == 0, POINT[data], LETTER[data]
    start, end, row = runs(text.view(np.uint8), offsets)
    stretches = Stretches(data)
    word = stretches.hashes(start, end)
    repeated = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = row[2:] == row[:-2]
        windows = mix(mix(mix(word[:-2]) + word[1:-1]) + word[2:])
        twice = np.zeros(len(windows), bool)
        twice[whole] = _again(windows[whole], row[:-2][whole])[0]
        for step in range(3):
            repeated[step : len(twice) + step] |= twice
    line_start, line_end, line_row = runs((data != 10).view(np.uint8), offsets)
    worded = within(text, line_start, line_end) > 0
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    copies = _again(stretches.hashes(line_start, line_end), line_row)[1]
    bare = within(letter | ((data >= 48) & (data <= 57)), start, end) == 0
    return [
        of(row), per_row(text & point, offsets), per_row(SYMBOL[data], offsets), of(line_row, copies), of(row, repeated),
        of(line_row), per_row(letter, offsets), per_row(UPPER[data], offsets), per_row(letter & text, offsets), of(row, bare),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in buffers(batch.column("text")):
            found = [pa.array(x, pa.int64()) for x in measure(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(offsets) - 1), *found], names=["doc_id", *MEASURES])


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    place = {r.name: i for i, r in enumerate(rules())}
    return sum(1 << place[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's measurements and ``failed_rules``, a bit for each rule that it fails.

    A text is read once, whole; no rows meet, so there is no shuffle. A null text is measured as an empty one,
    which fails ``few_words`` alone; repeated rows and null ids are rows like others; an empty table gives
    an empty ledger; other columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = StructType().add("doc_id", docs.schema[id_col].dataType)
    for name in MEASURES:
        schema = schema.add(name, LongType())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, schema)
    bits = [F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules())]
    return rows.withColumn("failed_rules", sum(bits[1:], bits[0]))


def keeps(policy: Policy, bits: Column | None = None, without: int = 0) -> Column:
    """Whether the policy keeps a ledger's row; ``without`` holds bits of rules that it is to forget."""
    bits = F.col("failed_rules") if bits is None else bits
    fatal = bits.bitwiseAND(F.lit(mask(policy.fatal) & ~without).cast("long")) == 0
    return fatal & (F.bit_count(bits.bitwiseAND(F.lit(mask(policy.named) & ~without).cast("long"))) <= policy.allowed)


def ablations(rows: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """(policy, version, rule, failed, only, kept, kept_without) for every policy and each of its rules.

    ``failed`` counts the ledger's rows that fail the rule, ``only`` those that fail it and no other rule of the policy,
    ``kept`` those that the policy keeps and ``kept_without`` those that it would keep if it forgot the rule. Rows are folded to one count
    for each set of failure bits first, so texts are not read again and at most 2 to the number of rules rows are shuffled by a task.
    """
    sets = rows.groupBy("failed_rules").agg(F.count("*").alias("n"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    out = []
    for p in policies or POLICIES:
        every = mask(p.fatal) | mask(p.named)
        for rule in (*p.fatal, *p.named):
            bit, bits = mask((rule,)), F.col("failed_rules")
            out.append(F.struct(
                F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), n(bits.bitwiseAND(F.lit(bit).cast("long")) != 0).alias("failed"),
                n(bits.bitwiseAND(F.lit(every).cast("long")) == bit).alias("only"), n(keeps(p)).alias("kept"), n(keeps(p, without=bit)).alias("kept_without"),
            ))
    return sets.agg(F.array(*out).alias("all")).select(F.inline("all"))


def rule_verdicts(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements of the contract, base_failed, kept, failed_rules: the ledger under the base policy and under ``policy``."""
    return ledger(docs, id_col, text_col).select(
        "doc_id", *MEASURES[:5], (~keeps(BASE)).alias("base_failed"), (keeps(BASE) & keeps(policy)).alias("kept"), "failed_rules",
    )
