"""Personal identifiers by bootstrapped contextual extraction.

Candidates are read outward from each digit, @ and = sign, up to the next delimiter, however far that is: tokens around an @, runs
of digit groups (a run of more than 34 digits is read as its blank-separated groups), IBANs with blanks, groups of hex digits, all
other tokens of 6 characters or more that mix letters and digits, and whatever is assigned by a = sign.
Strict validators (mail addresses of a known top-level domain, telephone numbers with a valid area code, public IP
addresses, card numbers with a valid check digit, IBANs with valid check digits, hex keys after an assignment, keys of a public format)
give the seeds. Each occurrence of a candidate has lexical patterns: its shape with the words before it, its shape with the word after
it, its shape alone, and the words on both sides whatever its shape, so that a context that seeds have filled finds identifiers of
a form that no seed has. A shape keeps punctuation and replaces letters and digits by classes.

The graph of patterns and instances is scored in Spark for some rounds: a pattern's confidence is the sum of its accepted instances'
scores over the number of all its instances + prior; an instance's score is the noisy-or of its patterns' confidences, each damped by trust, and seeds keep 1.
Instances that reach accept become identifiers, of the kind most of their patterns' seeds have; so a card number with a wrong check
digit, or a telephone number with an invalid area code, is found by the company its patterns keep.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.llm.kernels import blocks, flat
from kakari.llm.util import cut, fresh, pick

DELIMITERS = frozenset(" \t\r\n\f\v\x85\xa0\u2028\u2029\u3000\"'<>()[]{},;|=:")
DELIMITER = re.compile("[" + re.escape("".join(sorted(DELIMITERS))) + "]")
MAIL_STOP = re.compile(r"[!?#$%&*/]")
WHOLE = re.compile(r"(?:\d{1,3}(?:\.\d{1,3}){3}|\d{13,19})(?![\w@]|[./-]\w)|\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ -]\d{4}(?!\w)")
DIGITS = re.compile(r"\+?\(?\d(?:[ ()./-]{0,2}\d)*")
IBAN = re.compile(r"[A-Z]{2}\d\d(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![\w@])")
HEX_GROUPS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){5,7}(?![\w:])")
ASSIGNED = re.compile(r"=[ ]?[\"']?")
MOST_DIGITS = 34
NEAR = re.compile(r"[\w'=:@+]+", re.U)
TOP = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co"


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def seed_kind(value: str, before: str) -> str | None:
    """The kind of a value that passes a strict test."""
    digits = re.sub(r"\D", "", value)
    if re.fullmatch(rf"[a-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@(?:[a-z0-9-]+\.)+(?:{TOP})", value, re.I):
        return "email"
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value):
        parts = [int(x) for x in value.split(".")]
        return "ip" if all(x < 256 for x in parts) and 0 < parts[0] < 224 and parts[0] != 127 else None
    if re.fullmatch(r"\+1[ .-]?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]?\d{4}", value):
        return "phone"
    if re.fullmatch(r"\+[2-9]\d{0,2}(?:[ .-]?\d{2,4}){2,5}", value) and 8 <= len(digits) <= 15:
        return "phone"
    if re.fullmatch(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}", value) and 13 <= len(digits) <= 19 and luhn(digits):
        return "card"
    if re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", value):
        return "ssn"
    if iban(value):
        return "iban"
    if re.fullmatch(r"[0-9a-f]{32,64}", value, re.I) and re.search(r"(?:token|key|secret|password)\W*[=:]\W*$", before, re.I):
        return "key"
    if re.fullmatch(r"AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36,}|[rs]k_live_[0-9A-Za-z]{16,}", value):
        return "key"
    if value.count(":") >= 2:
        try:
            return "ip" if ipaddress.ip_address(value).is_global else None
        except ValueError:
            return None
    return None


def iban(value: str) -> bool:
    bare = value.replace(" ", "")
    return bool(re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def shape(value: str) -> str:
    """Digits as 9 and letters as a, runs of letters mixed with digits as x or, in long tokens, X, each with its length; groups of hex digits as h; in mail addresses without lengths."""
    if re.fullmatch(r"[a-zA-Z0-9_]{12,}", value) and re.search(r"\d", value) and re.search(r"[a-zA-Z]", value):
        return f"X{min(len(value), 128) // 8 * 8}"
    if "@" in value:
        return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", value))
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value):
        return "9.9.9.9"
    if re.fullmatch(r"[0-9A-Fa-f]*(?:[-:][0-9A-Fa-f]*)+", value) and re.search(r"[A-Fa-f:]", value):
        return re.sub(r"[0-9A-Fa-f]+", lambda m: f"h{{{len(m[0])}}}", value)
    kind = lambda x: "9" if x.isdigit() else "a" if x.isalpha() else "x"
    return re.sub(r"[^\W_]+", lambda m: f"{kind(m[0])}{{{len(m[0])}}}", value)


SIGN = np.zeros(256, bool)
SIGN[[*b"0123456789@="]] = True


def token_at(text: str, at: int, spot: int, stops=DELIMITERS) -> tuple[int, int]:
    """The span between delimiters around a character, from `at` on."""
    a = spot
    while a > at and text[a - 1] not in stops:
        a -= 1
    m = DELIMITER.search(text, spot)
    return a, m.start() if m else len(text)


def digit_run(text: str, at: int, spot: int) -> list[tuple[int, int]]:
    """The spans of digit groups that begin at a digit, if nothing but blanks or brackets stands around them."""
    a = spot
    if a > at and text[a - 1] == "(" and ")" in DIGITS.match(text, a)[0]:
        a -= 1
    if a > at and text[a - 1] == "+":
        a -= 1
    if a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.@/+-"):
        return []
    if a == spot or text[a] == "+":
        if m := WHOLE.match(text, a):
            return [m.span()]
    m = DIGITS.match(text, a)
    if not m or re.match(r"[\w@]|[./-]\w", text[m.end() : m.end() + 2]):
        return []
    if sum(map(str.isdigit, m[0])) <= MOST_DIGITS:
        return [m.span()]
    return [(a + g.start(), a + g.end()) for g in re.finditer(r"[^ ]+", m[0])]


def spans_at(text: str, at: int, spot: int) -> list[tuple[int, int]]:
    """The candidates around one sign, before any is trimmed or found too short; the last one's end is where reading goes on."""
    sign = text[spot]
    if sign == "=":
        a = ASSIGNED.match(text, spot).end()
        return [(a, token_at(text, a, a)[1])]
    a, b = token_at(text, at, spot)
    if "@" in text[a:b] and (sign == "@" or "@" in text[spot:b]):
        name = text.index("@", spot, b)
        stop = MAIL_STOP.search(text, name, b)
        return [(a, stop.start() if stop else b)]
    if sign == "@":
        return []
    if text[b : b + 1] == ":" or (a > 0 and text[a - 1] == ":"):
        start = a
        while start > at and (text[start - 1] in ":" or text[start - 1] in "0123456789abcdefABCDEF") and a - start < 40:
            start -= 1
        m = HEX_GROUPS.match(text, start)
        if m and m.end() > spot and not (start > 0 and text[start - 1].isalnum()):
            return [m.span()]
    if spot - a == 2 and (m := IBAN.match(text, a)) and not (a > 0 and text[a - 1].isalnum()):
        ends = [m.end()] + [i for i in range(m.end() - 1, a + 14, -1) if text[i] == " "]
        if good := next((end for end in ends if iban(text[a:end])), None):
            return [(a, good)]
    if run := digit_run(text, at, spot):
        return run
    return [(a, b)]


def occurrences(text: str, spots: np.ndarray):
    """(start, end, value, shape, words before, word after, seed kind) of the candidates around the characters at spots, in order."""
    at = 0
    for spot in spots.tolist():
        if spot < at:
            continue
        found = spans_at(text, at, spot)
        for a, b in found:
            at = max(at, b)
            while b > a and text[b - 1] in ".-:_/ (+!?&":
                b -= 1
            while a < b and text[a] in ".-:_/ )&!?":
                a += 1
            value = text[a:b]
            if len(value) < 6 or not (text[spot] == "=" or "@" in value[1:-1] or any(c.isdigit() for c in value)):
                continue
            before, after = text[max(0, a - 48) : a], text[b : b + 48]
            left, right = NEAR.findall(before), NEAR.search(after)
            yield a, b, value, shape(value), " ".join(left[-2:]).lower() if left else "^", right[0].lower() if right else "$", seed_kind(value, before)
        at = max(at, spot + 1)


def spots_of(texts: pa.Array):
    """For each text with digits or @ in it: its number, itself, and the positions of those characters."""
    data, at = flat(texts)
    byte = np.flatnonzero(SIGN[data])
    text = np.searchsorted(at, byte, "right") - 1
    edges = np.searchsorted(text, np.arange(len(at)))
    # a character starts at each byte that isn't a continuation
    for t in np.flatnonzero(np.diff(edges)):
        raw = data[at[t] : at[t + 1]]
        inside = byte[edges[t] : edges[t + 1]] - at[t]
        starts = np.cumsum((raw & 0xC0) != 0x80) - 1
        yield int(t), raw.tobytes().decode("utf-8", "replace"), starts[inside]


FIELDS = "start int, stop int, value string, shape string, before string, after string, seed string"


def find(batches):
    """The mapInArrow function over (key columns..., text): the candidates."""
    for batch in blocks(batches):
        rows, owner = [], []
        for t, text, spots in spots_of(batch.column(1)):
            for row in occurrences(text, spots):
                owner.append(t)
                rows.append(row)
        own = batch.column(0).take(pa.array(owner, pa.int64()))
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([own, *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], ["key", "start", "stop", "value", "shape", "before", "after", "seed"])


def score_graph(found: DataFrame, rounds: int, prior: float, trust: float, accept: float) -> tuple[DataFrame, DataFrame]:
    """From candidates: accepted instances (value, kind, confidence) and scored patterns (pattern, confidence).

    found has value, shape, before, after and seed; the graph's edges are its distinct (pattern, value) pairs.
    """
    patterns = F.array(F.concat(F.lit("L "), "before", F.lit(" _ "), "shape"), F.concat(F.lit("R "), "shape", F.lit(" _ "), "after"), F.concat(F.lit("S "), "shape"), F.concat(F.lit("C "), "before", F.lit(" _ "), "after"))
    graph = cut(found.select("value", F.explode(patterns).alias("pattern")).distinct())
    seeds = found.groupBy("value").agg(F.max("seed").alias("seed"))
    score = cut(seeds.select("value", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score")))
    confidence = None
    for _ in range(rounds):
        confidence = cut(graph.join(score, "value").groupBy("pattern").agg((F.sum(F.when(F.col("score") >= accept, F.col("score")).otherwise(0.0)) / (F.count("*") + prior)).alias("confidence"), F.max(F.when(F.col("score") >= accept, F.col("seed"))).alias("kind")))
        pooled = graph.join(confidence, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-trust * F.col("confidence"))))).alias("pooled"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("confidence", "pattern"))).alias("near"))
        score = cut(score.join(pooled, "value").select("value", F.coalesce("seed", F.when(F.col("pooled") >= accept, F.col("near"))).alias("seed"), F.when(F.col("score") >= 1, 1.0).otherwise(F.col("pooled")).alias("score")))
    return score.where((F.col("score") >= accept) & F.col("seed").isNotNull()).select("value", F.col("seed").alias("kind"), F.col("score").alias("confidence")), confidence


DEFAULTS = {"rounds": 3, "prior": 1.0, "trust": 0.9, "accept": 0.35}


def find_identifiers(docs: DataFrame, **options) -> DataFrame:
    """Every occurrence of an identifier: doc_id, start, stop (characters), value, kind, confidence.

    docs has doc_id and text; other columns are ignored. Only the candidates are shuffled, never texts. Values of fewer than 6
    characters are none; nothing bounds their length. Patterns see up to 48 characters on either side. Defined results: null and empty texts hold
    nothing; repeated rows and null doc_ids each give their rows; the same value has one kind and confidence everywhere (ties between kinds
    go to the last by name). Without seeds nothing is found; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = cut(pick(docs, doc_id="doc_id", text="text").mapInArrow(find, f"key {kind}, {FIELDS}"))
    accepted, _ = score_graph(found, **(DEFAULTS | options))
    return found.select(F.col("key").alias("doc_id"), "start", "stop", "value").join(accepted, "value").select("doc_id", "start", "stop", "value", "kind", "confidence")


def redact(docs: DataFrame, max_values: int = 2_000_000, **options) -> DataFrame:
    """docs with each identifier of find_identifiers replaced by <KIND>; n_chars, if there is one, is the new text's length.

    All rows and columns stay. Up to max_values accepted values are broadcast and replaced in one scan, in which candidates are extracted again; more are joined by
    the text's hash instead. Null and empty texts stay as they are.
    """
    names = docs.columns
    h = F.xxhash64("text")
    found = cut(docs.select(h.alias("h"), "text").mapInArrow(find, f"key long, {FIELDS}"))
    accepted, _ = score_graph(found, **(DEFAULTS | options))
    accepted = cut(accepted.select("value", "kind"))
    if accepted.count() <= max_values:
        table = docs.sparkSession.sparkContext.broadcast({r.value: r.kind for r in accepted.toLocalIterator()})
        out = docs.mapInArrow(replacer(names.index("text"), lambda batch, i, value: table.value.get(value)), docs.schema)
    else:
        spans = found.join(accepted, "value").groupBy("key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("value", "kind")))).alias("kinds"))
        own, other, kinds = (fresh(docs, c) for c in ("__h", "__key", "__kinds"))
        joined = docs.withColumn(own, h).join(spans.select(F.col("key").alias(other), F.col("kinds").alias(kinds)), F.col(own) == F.col(other), "left").select(*names, F.to_json(kinds).alias(kinds))
        import json

        at = len(names)
        out = joined.mapInArrow(replacer(names.index("text"), lambda batch, i, value: json.loads(batch.column(at)[i].as_py() or "{}").get(value)), joined.schema).select(*names)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)


def replacer(at: int, kind_of):
    """The mapInArrow function over whole rows."""

    def run(batches):
        for batch in blocks(batches, at):
            changed = {}
            for t, text, spots in spots_of(batch.column(at)):
                parts, upto = [], 0
                for a, b, value, *_ in occurrences(text, spots):
                    if kind := kind_of(batch, t, value):
                        parts += [text[upto:a], f"<{kind.upper()}>"]
                        upto = b
                if parts:
                    changed[t] = "".join(parts) + text[upto:]
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                new = pc.replace_with_mask(batch.column(at), pa.array(mask), pa.array([changed[t] for t in sorted(changed)], batch.column(at).type))
                batch = pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return run
