"""What is read off a block's text: markers, pronouns, demonstratives, entities, noun phrases, heading paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.arrays import first_of, let, scan
from loam.functions.lexicons import DEMONSTRATIVES, LANGUAGES, MARKERS, PRONOUNS, STOPWORDS, STRENGTH, marker_phrases
from loam.functions.text import ASCII_PUNCTUATION, SPACE, block_tokens, first_word, is_upper, left_trim, trim_punctuation, words
from loam.functions.vectors import jaccard

ENTITY = "array<struct<surface:string,normalized:string,type:string>>"


def by_language(lang: Column, choices: dict[str, Column], default: Column) -> Column:
    out = default
    for code, value in choices.items():
        out = F.when(lang == code, value).otherwise(out)
    return out


def _start_pattern(phrases: list[str]) -> str:
    return "^(?:" + "|".join(re.escape(p) for p in phrases) + ")"


def discourse_marker(text: Column, lang: Column) -> Column:
    """The marker whose phrase the text starts with, or null. Phrases of one marker make one pattern."""

    def found(low: Column) -> Column:
        def of(code: str) -> Column:
            out = F.lit(None).cast("string")
            for marker in reversed(MARKERS[code]):
                out = F.when(low.rlike(_start_pattern([p for p, m in marker_phrases(code) if m == marker])), F.lit(marker)).otherwise(out)
            return out

        return by_language(lang, {code: of(code) for code in MARKERS}, F.lit(None).cast("string"))

    return let(F.lower(left_trim(text)), found)


def marker_strength(marker: Column) -> Column:
    out = F.lit(0.0)
    for name, value in STRENGTH.items():
        out = F.when(marker == name, F.lit(value)).otherwise(out)
    return out


def starts_with_pronoun(text: Column, lang: Column) -> Column:
    return let(first_word(text), lambda w: by_language(lang, {c: w.isin(p.split()) for c, p in PRONOUNS.items()}, F.lit(False)))


def starts_with_demonstrative(text: Column, lang: Column) -> Column:
    low = F.lower(left_trim(text))
    return let(low, lambda t: by_language(lang, {c: t.rlike(_start_pattern([f"{d} " for d in ds])) for c, ds in DEMONSTRATIVES.items()}, F.lit(False)))


def _stopwords(lang: Column) -> Column:
    # One foldable call a language: an array of literals costs the driver a call for each word.
    return by_language(lang, {c: F.split(F.lit(" ".join(s.split())), " ") for c, s in STOPWORDS.items()}, F.array().cast("array<string>"))


def _flagged(text: Column, lang: Column) -> Column:
    """The stretches of a text that hold capitalised words, as arrays of their words with what the span rules ask of them.

    A stretch is words with a capital in front and the punctuation words between them; a sentence's end before it is its
    first word. One regular expression finds all of them, so no other word is looked at. Its loops give nothing back, which
    keeps them off the stack whatever their length.
    """
    punctuation = "[" + re.escape(ASCII_PUNCTUATION) + "]"
    capital = rf"{punctuation}*+\p{{Lu}}[^{SPACE}]*+"
    stretch = rf"((?:[.!?][{SPACE}]++|(?<![^{SPACE}])){capital}(?:[{SPACE}]++(?:{capital}|{punctuation}++(?![^{SPACE}])))*+)"

    def one(stop: Column) -> Column:
        def marked(word: Column, w: Column, upper: Column) -> Column:
            ends = F.endswith(word, F.lit(".")) | F.endswith(word, F.lit("!")) | F.endswith(word, F.lit("?"))
            return F.struct(w.alias("w"), upper.alias("upper"), (upper & F.array_contains(stop, F.lower(w))).alias("stop"), ends.alias("ends"))

        def flag(word: Column) -> Column:
            return let(trim_punctuation(word), lambda w: let(is_upper(w) & (F.octet_length(w) > 1), lambda u: marked(word, w, u)))

        # The start of a text counts as the end of a sentence.
        return F.transform(F.regexp_extract_all(F.concat(F.lit(". "), text), F.lit(stretch), F.lit(1)), lambda s: F.transform(words(s), flag))

    return let(_stopwords(lang), one)


def _phrase(stretch: Column, start: Column, n: Column) -> Column:
    """An array of one: the words of a part of a stretch, punctuation words left out."""
    return F.array(F.array_join(F.filter(F.transform(F.slice(stretch, start, n), lambda x: x["w"]), lambda w: w != ""), " "))


def capitalised_spans(text: Column, lang: Column, flagged: Column | None = None) -> Column:
    """Runs of capitalised words that start with no function word; a single one counts unless a sentence starts there.
    ``flagged`` are the text's stretches where they are at hand. A run is held as its start, so long runs cost no copies."""
    zero = {"start": F.lit(0), "at": F.lit(1), "opening": F.lit(False), "ended": F.lit(False)}

    def spans(stretch: Column) -> Column:
        def closed(s: Column, ends: Column) -> Column:
            n = s["at"] - s["start"]
            real = (s["start"] > 0) & ((n >= 2) | ~s["opening"])
            return F.when(ends & real, _phrase(stretch, s["start"], n)).otherwise(F.array().cast("array<string>"))

        def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
            running = s["start"] > 0
            after = {
                "start": F.when(~x["upper"], 0).when(running, s["start"]).when(x["stop"], 0).otherwise(s["at"]),
                "at": s["at"] + 1,
                "opening": F.when(running, s["opening"]).otherwise(s["ended"]),
                "ended": x["ends"],
            }
            return after, closed(s, ~x["upper"])

        return scan(stretch, "string", zero, step, lambda out, s: F.concat(out, closed(s, F.lit(True))))

    return F.flatten(F.transform(_flagged(text, lang) if flagged is None else flagged, spans))


def noun_phrases(text: Column, lang: Column, flagged: Column | None = None) -> Column:
    """Runs of two or more capitalised words that are no function words; punctuation alone breaks no run."""
    zero = {"start": F.lit(0), "at": F.lit(1), "n": F.lit(0)}

    def phrases(stretch: Column) -> Column:
        def closed(s: Column, ends: Column) -> Column:
            return F.when(ends & (s["n"] >= 2), _phrase(stretch, s["start"], s["at"] - s["start"])).otherwise(F.array().cast("array<string>"))

        def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
            grows, passes = x["upper"] & ~x["stop"], x["w"] == ""
            after = {
                "start": F.when(passes, s["start"]).when(~grows, 0).when(s["n"] > 0, s["start"]).otherwise(s["at"]),
                "at": s["at"] + 1,
                "n": F.when(passes, s["n"]).when(grows, s["n"] + 1).otherwise(0),
            }
            return after, closed(s, ~(grows | passes))

        return scan(stretch, "string", zero, step, lambda out, s: F.concat(out, closed(s, F.lit(True))))

    return F.flatten(F.transform(_flagged(text, lang) if flagged is None else flagged, phrases))


def _entity(surface: Column, normalized: Column, kind: str) -> Column:
    return F.struct(surface.alias("surface"), normalized.alias("normalized"), F.lit(kind).alias("type"))


def demonstrative_entities(text: Column) -> Column:
    """The noun after an English demonstrative at the text's start."""

    def one(low: Column) -> Column:
        found = []
        for prefix in DEMONSTRATIVES["en"]:
            noun = trim_punctuation(F.regexp_extract(low, rf"^{prefix} \s*(\S+)", 1))
            found.append(F.when(F.octet_length(noun) >= 2, _entity(F.concat(F.lit(f"{prefix} "), noun), noun, "Demonstrative")))
        return F.array_compact(F.array(*found))

    return let(F.lower(text), one)


def pronoun_entities(text: Column) -> Column:
    one = lambda w: F.when(w.isin(PRONOUNS["en"].split()), F.array(_entity(w, w, "Pronoun"))).otherwise(F.array().cast(ENTITY))
    return let(first_word(text), one)


def katakana_spans(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\p{IsKatakana}[\p{IsKatakana}・ー]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[・ー]+$", "")), lambda x: F.length(x) >= 2)


def latin_spans(text: Column) -> Column:
    """Latin runs of two bytes or more in texts whose letters are at most half Latin; digits may follow a letter."""
    letters, latin = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(text, F.lit(r"(?=\p{IsAlphabetic})\p{IsLatin}"))
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(\p{IsLatin}[\p{IsLatin}0-9]*)"), F.lit(1)), lambda x: F.octet_length(x) >= 2)
    return F.when((letters > 0) & (latin * 2 <= letters), found).otherwise(F.array().cast("array<string>"))


def script_entities(text: Column, lang: Column) -> Column:
    spans = F.when(lang.isin("zh", "ja", "ko", "ar"), F.concat(katakana_spans(text), latin_spans(text))).otherwise(F.array().cast("array<string>"))
    return F.transform(spans, lambda s: _entity(s, F.lower(s), "Named"))


def first_of_each(entities: Column) -> Column:
    """Entities without later ones of the same normalised form and type."""
    return first_of(entities, lambda e: e["normalized"], lambda e: e["type"])


def entities(text: Column, lang: Column, heading_terms: Column | None = None, flagged: Column | None = None) -> Column:
    """array<struct<surface, normalized, type>>: capitalised spans, heading terms, demonstratives, pronouns, script runs."""
    terms = heading_terms if heading_terms is not None else F.array().cast("array<string>")
    named = F.transform(capitalised_spans(text, lang, flagged), lambda s: _entity(s, F.lower(s), "Named"))
    met = let(F.lower(text), lambda low: F.filter(terms, lambda t: F.contains(low, t)))
    from_headings = F.transform(F.array_sort(met), lambda t: _entity(t, t, "Named"))
    return first_of_each(F.concat(named, from_headings, demonstrative_entities(text), pronoun_entities(text), script_entities(text, lang)))


def entity_overlap(a: Column, b: Column) -> Column:
    return jaccard(a["normalized"], b["normalized"])


def noun_phrase_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.transform(a, F.lower), F.transform(b, F.lower))


# Headings


def heading_level(text: Column) -> Column:
    return F.greatest(F.length(F.regexp_extract(text, "^(#*)", 1)), F.lit(1))


def heading_title(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "^#+", ""), F.lit(" \t\r\n"))


def heading_paths(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``heading_path`` to block rows: the open headings, outermost first, a heading's own included.

    For each level the nearest heading of that level counts unless one of a smaller level came after it. One window.
    """
    w = Window.partitionBy(key).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("kind") == "Heading"
    leveled = rows.withColumn("_level", F.when(is_heading, heading_level(F.col("text"))))
    last = lambda k: F.last(F.when(F.col("_level") == k, F.struct("block_idx", heading_title(F.col("text")).alias("title"))), ignorenulls=True).over(w)
    for k in range(1, 7):
        leveled = leveled.withColumn(f"_h{k}", last(k))
    parts = []
    for k in range(1, 7):
        at = F.col(f"_h{k}.block_idx")
        above = [F.coalesce(F.col(f"_h{j}.block_idx"), F.lit(-1)) for j in range(1, k)]
        newest = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        parts.append(F.when(at > newest, F.col(f"_h{k}.title")))
    return leveled.withColumn("heading_path", F.array_compact(F.array(*parts))).drop("_level", *[f"_h{k}" for k in range(1, 7)])


def heading_terms(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, terms): lower-cased heading titles and their words of three bytes or more, without ASCII punctuation."""
    title = F.lower(heading_title(F.col("text")))
    parts = F.filter(F.transform(words(title), trim_punctuation), lambda w: F.octet_length(w) >= 3)
    found = rows.where("kind = 'Heading'").select(key, F.explode(F.concat(parts, F.array(title))).alias("term")).where("term <> ''")
    return found.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def heading_continuity(a: Column, b: Column) -> Column:
    """Length of the common start over the longer path; 1 for equal paths."""

    def shared(pair: Column) -> Column:
        same = F.zip_with(pair["a"], pair["b"], lambda x, y: F.coalesce(x == y, F.lit(False)))
        first_other = F.array_position(same, False)
        common = F.when(first_other == 0, F.size(same)).otherwise(first_other - 1)
        longer = F.greatest(F.size(pair["a"]), F.size(pair["b"]))
        return F.when(longer == 0, F.lit(1.0)).otherwise(common / longer)

    return let(F.struct(a.alias("a"), b.alias("b")), shared)


# Language


def detect_language(text: Column) -> Column:
    """By script, then by the share of function words; "en" where nothing tells."""
    low = F.lower(text)

    def by_words(tokens: Column) -> Column:
        # A word of no list is met once, not once for each language.
        listed = F.filter(tokens, lambda t: t.isin(sorted({w for s in STOPWORDS.values() for w in s.split()})))

        def best(found: Column) -> Column:
            hits = lambda code: F.size(F.filter(found, lambda t: t.isin(STOPWORDS[code].split())))
            scored = F.array(*[F.struct(hits(c).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(STOPWORDS)])
            return let(F.array_max(scored), lambda m: F.when(m["n"] > 0, m["c"]).otherwise(F.lit("en")))

        return let(listed, best)

    return (
        F.when(text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), F.lit("ja")).when(text.rlike(r"\p{IsHangul}"), F.lit("ko"))
        .when(text.rlike(r"\p{IsHan}"), F.lit("zh")).when(text.rlike(r"\p{IsArabic}"), F.lit("ar"))
        .otherwise(by_words(F.transform(words(low), trim_punctuation)))
    )


def document_language(rows: DataFrame, key: str = "doc_id", sample: int = 5) -> DataFrame:
    """(key, lang) detected on the first blocks that are no headings."""
    w = Window.partitionBy(key).orderBy("block_idx")
    first = rows.where("kind <> 'Heading'").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= sample)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), " ")
    return first.groupBy(key).agg(detect_language(joined).alias("lang"))


def enrich(rows: DataFrame, key: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """Block rows (key, block_idx, text, offset_start, offset_end, kind, lang) with everything scoring asks for.

    ``terms`` (key, terms) are a document's heading terms. The window is by ``key``, as all later ones.
    """
    w = Window.partitionBy(key).orderBy("block_idx")
    text, lang = F.col("text"), F.col("lang")
    marked = heading_paths(rows, key)
    if terms is not None:
        marked = marked.join(terms, key, "left")
    known = F.coalesce(F.col("terms"), F.array().cast("array<string>")) if terms is not None else None
    return (
        marked.withColumn("tokens", block_tokens(text))
        .withColumn("_flagged", _flagged(text, lang))
        .withColumn("entities", entities(text, lang, known, F.col("_flagged")))
        .withColumn("noun_phrases", noun_phrases(text, lang, F.col("_flagged")))
        .withColumn("marker", discourse_marker(text, lang))
        .withColumn("pronoun", starts_with_pronoun(text, lang))
        .withColumn("demonstrative", starts_with_demonstrative(text, lang))
        .withColumn("continues_list", F.coalesce((F.col("kind") == "List") & (F.lag("kind").over(w) == "List"), F.lit(False)))
        .drop("terms", "_flagged")
    )


def known_language(lang: Column) -> Column:
    """The language's code, or null where it is not known: then it has to be detected."""
    low = F.lower(lang)
    out = F.when(low.isin(list(LANGUAGES)), low)
    for code, others in LANGUAGES.items():
        out = out.when(low.isin(list(others)), F.lit(code))
    return out


def array_language(blocks: Column, sample: int = 5) -> Column:
    """The language detected on the first ``sample`` blocks of an array that are no headings. No shuffle."""
    plain = F.slice(F.filter(blocks, lambda b: b["kind"] != "Heading"), 1, sample)
    return detect_language(F.array_join(F.transform(plain, lambda b: b["text"]), " "))
