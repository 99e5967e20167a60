"""Text normalisation, label names, rule labels and rendering, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import uniform

# fixed values: words that carry no content
STOP_WORDS = (
    "the a an of to and or in on for is are was were be been it this that with as at by from "
    "what which who how does do did not no yes i you he she they we my your"
).split()
SYNONYMS = {"small": "little", "large": "big", "red": "crimson", "blue": "azure", "card": "bank card", "ring": "band"}


def norm_text(text: Column) -> Column:
    """Lower-case letters, digits and single spaces."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def norm_key(text: Column) -> Column:
    """The digest of the normalised text; null counts as empty."""
    return F.md5(norm_text(F.coalesce(text, F.lit(""))))


def value_key(**fields: Column) -> Column:
    """The key of a value that is no text: of its JSON with the names in order, nulls kept."""
    return norm_key(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}))


def clean(text: Column, max_chars: int) -> Column:
    """Literal backslash-n and runs of space become one space; a text over the limit ends at a space if there is one."""
    flat = F.trim(F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit(" ")), r"[ \t\n\r\f\x0B]+", " "))
    head = F.substring(flat, 1, max_chars)
    return F.when(F.char_length(flat) > max_chars, F.regexp_replace(head, " [^ ]*$", "")).otherwise(flat)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS))))


def humanize(name: Column) -> Column:
    """snake_case and CamelCase as lower-case words; twice, since neighbouring capitals overlap."""
    out = F.regexp_replace(name, "[_?]", " ")
    for _ in range(2):
        out = F.regexp_replace(out, "(.)([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(out, " +", " ")))


def source_of(label: Column) -> Column:
    return F.substring_index(label, "::", 1)


def intent_of(label: Column) -> Column:
    """What follows the first double colon; the whole label if there is none."""
    return F.regexp_replace(label, "^.*?::", "")


def normalized_name(label: Column) -> Column:
    """What follows the source, with one spelling for separators."""
    return F.translate(F.lower(intent_of(label)), "_-", "  ")


def with_synonyms(text: Column, seed: str, key: Column, share: float = 0.4) -> Column:
    """Each word that has a synonym is replaced by the share given, drawn by its place."""
    table = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    words = F.split(text, " ")
    swap = lambda w, i: F.when(uniform(seed, key, i) < share, F.coalesce(F.try_element_at(table, w), w)).otherwise(w)
    return F.array_join(F.transform(words, swap), " ")


def from_template(text: Column, templates: tuple[str, ...], seed: str, key: Column) -> Column:
    """The text in the place `{x}` of one of the templates, drawn by the key."""
    pick = F.element_at(F.array(*map(F.lit, templates)), (F.floor(uniform(seed, key) * len(templates)) + 1).cast("int"))
    return F.replace(pick, F.lit("{x}"), text)


def base_description(label: Column) -> Column:
    name = humanize(intent_of(label))
    return F.when(F.endswith(label, F.lit("::oos")), "a request that fits none of the others").otherwise(F.concat(F.lit("a request about "), name))


def negated(question: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), question, F.lit(" ")), F.lit(" not "))


def key_index(answer: Column, keys: Column) -> Column:
    """Index of an answer letter; else a number counted from one, if it is in range; else null."""
    at = F.array_position(keys, answer)
    number = F.try_to_number(answer, F.lit("999")).cast("int")
    return F.when(at > 0, at - 1).when(number.between(1, F.size(keys)), number - 1).cast("int")


def similarity_level(score: Column, levels: int = 5) -> Column:
    """Rounded half to even, as levels from 0."""
    return F.least(F.lit(levels - 1), F.bround(score * (levels - 1)).cast("int"))


def sorted_pair(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), " || ")


def cardinality_bucket(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 30, "11-30").otherwise("31+")


def depth_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def log_lengths(text: Column) -> tuple[Column, Column]:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.log1p(F.char_length(text)), F.log1p(words)


def token_estimate(chars: Column, n_options: Column) -> Column:
    return F.floor(chars / 3) + 64 * F.greatest(F.lit(1), n_options) + 160


def mcq_context(context: Column, question: Column) -> Column:
    return F.when(context != "", F.concat(context, F.lit("\n\nQuestion: "), question)).otherwise(question)


def marker_sequence(state: Column, options: Column, levels: Column) -> Column:
    """State, options, the rejection marker and levels in one line with their markers."""
    mark = lambda m: lambda x: F.concat(F.lit(m), x)
    parts = F.concat(F.array(F.concat(state, F.lit(" [SEP]"))), F.transform(options, mark("[OPT] ")), F.array(F.lit("[NOUL]")), F.transform(levels, mark("[LVL] ")))
    return F.array_join(parts, " ")
