"""Rows to text: tree, lattice, tree and lattice, XML and CoNLL, as expressions over sentence, tokens and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.patterns import PosSet, posset
from kakari.functions.text import concat_pos, csv_join, display_width, let, score_text, xml_escape
from kakari.schema import CHUNK, DEP, POS, RAW, SELECTION, joined_surface, tokens_of

TREE, LATTICE, TREE_LATTICE, XML, CONLL, NONE = range(6)
NAMES = {"tree": TREE, "lattice": LATTICE, "tree_lattice": TREE_LATTICE, "xml": XML, "conll": CONLL, "none": NONE}


def _first_of(chunks: Column) -> Column:
    """Token position to chunk number, for the first tokens of chunks."""
    return F.map_from_arrays(F.transform(chunks, lambda c: c["token_pos"]), F.transform(chunks, lambda c, i: i))


def token_line(t: Column) -> Column:
    return F.concat_ws("\t", t["surface"], t["feature"], t["ne"])


def chunk_line(c: Column, i: Column, layer: int) -> Column:
    head = F.concat(F.lit("* "), i.cast("string"), F.lit(" "), c["link"].cast("string"), F.lit("D "))
    if layer == CHUNK:
        return head
    head = F.concat(head, c["head_pos"].cast("string"), F.lit("/"), c["func_pos"].cast("string"), F.lit(" "), score_text(c["score"]))
    return F.concat(head, F.when(F.size(c["features"]) > 0, F.concat(F.lit(" "), csv_join(c["features"]))).otherwise("")) if layer == SELECTION else head


def _lines(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("\n"))), "")


def lattice(sentence: Column, tokens: Column, chunks: Column, layer: int = DEP) -> Column:
    """A line for each token, before the tokens of each chunk a line for it (not in the token layer), then EOS. The raw layer is the text alone."""
    if layer == RAW:
        return F.concat(F.when(F.size(tokens) > 0, joined_surface(tokens)).otherwise(sentence), F.lit("\n"))
    if layer == POS:
        return F.concat(_lines(F.transform(tokens, token_line)), F.lit("EOS\n"))
    outside = F.when(F.size(chunks) > 0, F.slice(tokens, F.lit(1), F.get(chunks, F.lit(0))["token_pos"])).otherwise(tokens)
    body = F.transform(chunks, lambda c, i: F.concat(chunk_line(c, i, layer), F.lit("\n"), _lines(F.transform(tokens_of(c, tokens), token_line))))
    return F.concat(_lines(F.transform(outside, token_line)), F.array_join(body, ""), F.lit("EOS\n"))


def xml(tokens: Column, chunks: Column, layer: int = DEP) -> Column:
    """A sentence element with chunk and tok elements; head and func are positions in the sentence here."""

    def tok(t, i):
        ne = F.when(t["ne"].isNull(), "").otherwise(F.concat(F.lit(' ne="'), xml_escape(t["ne"]), F.lit('"')))
        return F.concat(F.lit('  <tok id="'), i.cast("string"), F.lit('" feature="'), xml_escape(t["feature"]), F.lit('"'), ne, F.lit(">"), xml_escape(t["surface"]), F.lit("</tok>\n"))

    def opened(c, i):
        parts = {"id": i.cast("string"), "link": c["link"].cast("string"), "rel": F.lit("D"), "score": score_text(c["score"]), "head": (c["head_pos"] + c["token_pos"]).cast("string"), "func": (c["func_pos"] + c["token_pos"]).cast("string")}
        line = F.concat(F.lit(" <chunk"), *(F.concat(F.lit(f' {k}="'), v, F.lit('"')) for k, v in parts.items()))
        more = F.when(F.size(c["features"]) > 0, F.concat(F.lit(' feature="'), xml_escape(csv_join(c["features"])), F.lit('"'))).otherwise("") if layer == SELECTION else F.lit("")
        return F.concat(line, more, F.lit(">\n"))

    flat = F.array_join(F.transform(tokens, tok), "")
    if layer == POS:
        body = flat
    else:
        outside = F.when(F.size(chunks) > 0, F.slice(tokens, F.lit(1), F.get(chunks, F.lit(0))["token_pos"])).otherwise(tokens)
        one = lambda c, i: F.concat(opened(c, i), F.array_join(F.transform(tokens_of(c, tokens), lambda t, k: tok(t, k + c["token_pos"])), ""), F.lit(" </chunk>\n"))
        body = F.concat(F.array_join(F.transform(outside, tok), ""), F.array_join(F.transform(chunks, one), ""))
    return F.concat(F.lit("<sentence>\n"), body, F.lit("</sentence>\n"))


def _wrapped(tokens: Column) -> Column:
    """array<string>: surfaces with entity tags put around spans: <X> at a B, </X> before the next B or O, or after the last token."""

    def around(marks):
        tagged = F.filter(F.transform(marks, lambda m, k: F.when(F.startswith(m["ne"], F.lit("B")), F.struct((F.coalesce(F.get(marks, k + 1)["i"], F.size(tokens)) - 1).alias("at"), F.substring(m["ne"], 3, 1 << 30).alias("x")))), lambda x: x.isNotNull())

        def closed(ends):
            return F.transform(tokens, lambda t, i: F.concat(F.when(F.startswith(t["ne"], F.lit("B")), F.concat(F.lit("<"), F.substring(t["ne"], 3, 1 << 30), F.lit(">"))).otherwise(""), t["surface"], F.when(F.get(ends, i).isNotNull(), F.concat(F.lit("</"), F.get(ends, i), F.lit(">"))).otherwise("")))

        # an entity that a B interrupts at once ends at its own token
        return let(F.transform(tokens, lambda t, i: F.get(F.filter(tagged, lambda x: x["at"] == i), F.lit(0))["x"]), closed)

    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["ne"].alias("ne"))), lambda x: F.coalesce(x["ne"].rlike("^[BO]"), F.lit(False)))
    return F.when(F.exists(tokens, lambda t: F.coalesce(F.startswith(t["ne"], F.lit("B")), F.lit(False))), let(marks, around)).otherwise(F.transform(tokens, lambda t: t["surface"]))


def tree(tokens: Column, chunks: Column) -> Column:
    """Chunks right-aligned on a staircase, with lines to their heads; entities in tags. Width counts 2 for what isn't ASCII."""

    def drawn(texts):
        widths = F.transform(texts, display_width)
        links = F.transform(chunks, lambda c: c["link"])

        def rows(x):
            n, top = F.size(texts), F.coalesce(F.array_max(x["widths"]), F.lit(0))

            def row(text, i):
                link = F.get(x["links"], i)
                cell = lambda j: F.when(link == j, "-D").when(F.get(x["first"], j) < i, " |").when((link > i) & (link < j), "  ").otherwise("--")
                lines = F.when(i < n - 1, F.array_join(F.transform(F.sequence(F.least(i + 1, n - 1), n - 1), cell), "")).otherwise("")
                return F.concat(F.repeat(F.lit(" "), top - F.get(x["widths"], i) + 2 * i), text, lines)

            return _lines(F.transform(texts, row))

        # the first chunk that points at each, from before it; one that nothing points at has none
        first = F.transform(texts, lambda _, j: F.nullif(F.array_position(links, j).cast("int"), F.lit(0)) - 1)
        return let(F.struct(widths.alias("widths"), links.alias("links"), first.alias("first")), rows)

    texts = let(_wrapped(tokens), lambda w: F.transform(chunks, lambda c: F.array_join(F.slice(w, c["token_pos"] + 1, c["token_size"]), "")))
    return F.concat(let(texts, drawn), F.lit("EOS\n"))


def conll(tokens: Column, chunks: Column, layer: int = DEP, tags: str | PosSet = "IPA") -> Column:
    """Ten columns for each token. Inside a chunk a token's head is the next one; the last one's is the head word of the head chunk, 0 beyond the end."""
    ps = posset(tags)
    size = F.size(tokens)

    def line(t, j, c):
        at = c["token_pos"] + j
        end = (j == c["token_size"] - 1) & (c["link"] >= 0) & (c["link"] < F.size(chunks))
        to = F.get(chunks, c["link"])
        head = F.when(end, to["head_pos"] + to["token_pos"] + 1).otherwise(at + 2)
        rows = [(at + 1).cast("string"), t["surface"], F.when(F.size(t["features"]) >= ps.lemma_from, F.get(t["features"], F.lit(ps.lemma))).otherwise(t["norm"]), F.coalesce(F.get(t["features"], F.lit(0)), F.lit("_")), concat_pos(t["features"], ps.levels)]
        notes = [F.lit("feature="), t["feature"]]
        if layer >= CHUNK:
            notes.append(F.when(j == 0, "|begin_chunk=1").otherwise(""))
        if layer >= SELECTION:
            notes += [F.when(j == c["head_pos"], "|head=1").otherwise(""), F.when(j == c["func_pos"], "|func=1").otherwise("")]
        return F.concat_ws("\t", *rows, F.concat(*notes), F.when(head == size + 1, 0).otherwise(head).cast("string"), F.when(end, "D").otherwise("_"), F.lit("_"), F.lit("_"))

    body = F.transform(chunks, lambda c: _lines(F.transform(tokens_of(c, tokens), lambda t, j: line(t, j, c))))
    return F.concat(F.array_join(body, ""), F.lit("\n"))


def formatted(style: int | str, layer: int = DEP, tags: str | PosSet = "IPA") -> Column:
    """The text of a row (sentence, tokens, chunks). An unknown style raises ValueError. Layers below 4 have the lattice only."""
    style = NAMES.get(style, style) if isinstance(style, str) else style
    if style not in NAMES.values():
        raise ValueError(f"unknown format: {style}")
    if style == NONE:
        return F.lit("")
    if layer != DEP and style in (TREE, TREE_LATTICE):
        style = LATTICE

    def made(row):
        s, t, c = row["sentence"], row["tokens"], row["chunks"]
        if style == TREE:
            return tree(t, c)
        if style == LATTICE:
            return lattice(s, t, c, layer)
        if style == TREE_LATTICE:
            return F.concat(tree(t, c), lattice(s, t, c, layer))
        return xml(t, c, layer) if style == XML else conll(t, c, layer, tags)

    return let(F.struct("sentence", "tokens", "chunks"), made)


def to_text(df: DataFrame, style: int | str = TREE, layer: int = DEP, tags: str | PosSet = "IPA", out: str = "text") -> DataFrame:
    """df with the formatted text of each row. A layer that a style needs and the row lacks (null chunks) counts as empty."""
    return df.withColumn("chunks", F.coalesce("chunks", F.array())).withColumn(out, formatted(style, layer, tags)) if "chunks" in df.columns else df.withColumn("chunks", F.array().cast("array<struct<link:int,head_pos:int,func_pos:int,token_pos:int,token_size:int,score:float,features:array<string>>>")).withColumn(out, formatted(style, layer, tags)).drop("chunks")


def write_text(df: DataFrame, path: str, style: int | str = TREE, layer: int = DEP, tags: str | PosSet = "IPA") -> None:
    """The formatted rows as text files; blocks follow each other without further separators."""
    to_text(df, style, layer, tags, "__text").select(F.regexp_replace("__text", "\n$", "").alias("value")).write.text(path)
