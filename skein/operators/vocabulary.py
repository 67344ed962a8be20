"""Repair of names that a recogniser nearly got, from a list of terms, and its undo.

Terms and runs of words meet by keys that any match of a rule must share (the word itself, what is left
of it without one letter, its consonants), never as all pairs; the terms' keys are of bounded number, as
a list keeps TERMS terms, and go by broadcast. What meets is verified, each place of a line takes its
best claim, and claims are taken from left to right where they don't overlap. Rules go from tight to loose:

0. the term itself in other letter case or with other marks (three letters at least);
1. one letter inserted, missing, changed or swapped with its neighbour (terms of seven letters);
2. another first sound before the same later ones, in a word that is written as a name within a sentence
   (terms of seven sounds, four consonants of them); or, over several words, the same consonants,
   three letters' difference at most and the same first two letters;
3. one to three letters in front of the term, itself with one letter's difference at most, in a word that is
   written as a name or wears an elided article (terms of five letters).

Everyday words are a table of their own (``frequent`` derives one); they are never rewritten, and a term
that is one fixes its own spelling only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms that a list keeps, and the least letters (of a word, a term by its tail, a term by its sound), sounds and consonants.
TERMS, WORD, BURIED, ALIKE, SOUNDS, SPINE = 200, 4, 5, 7, 7, 4
#: Marks that end a sentence, and marks that may stand between one and the next word.
STOPS, OPENERS = ".!?:;…", "\"'’«([“—-"
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}'’._-]*[\p{L}\p{N}])?"
_GAPPED = rf"([^\p{{L}}\p{{N}}]*)({_WORD})"


def shortened(word: Column) -> Column:
    """The word, and the word without each of its letters: two words with one edit or swap between them share one."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(word == "", F.array()).otherwise(F.array_distinct(F.array_append(less, word)))


def tail_distance(term: Column, word: Column, most: int = 1, octets: bool = False) -> Column:
    """Whether ``term`` is within ``most`` edits (of bytes with ``octets``) of an end of ``word`` that leaves a letter at least before it."""
    starts, seen = F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), T.octets if octets else T.col
    return (F.length(word) > 1) & F.exists(starts, lambda i: F.levenshtein(seen(F.substring(word, i, F.length(word))), seen(term)) <= most)


def frequent(lines: DataFrame, share: int = 2000, text: str = "text") -> DataFrame:
    """``word``: folded words that are at least one in ``share`` of all words (so ``share`` of them at most), of WORD letters or more."""
    words = lines.select(F.explode(T.words(text)).alias("w")).select(T.fold("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("total")).withColumn("all", F.lit(1))  # one row
    return words.withColumn("all", F.lit(1)).join(F.broadcast(total), "all").where((F.col("n") * share >= F.col("total")) & (F.length("word") >= WORD)).select("word")


def glossary(terms: DataFrame, everyday: DataFrame, term: str = "term", place: str = "place") -> DataFrame:
    """The first TERMS terms in order of ``place`` (then of the term), first spellings only, with what the rules ask of them.

    Null and blank terms, and terms without a letter or digit, are no terms.
    """
    rows = terms.select(F.trim(term).alias("term"), F.col(place).alias("place")).withColumn("t", T.fold("term")).where("t <> ''")
    first = rows.groupBy("t").agg(F.min(F.struct("place", "term")).alias("of")).select("t", "of.*").orderBy("place", "term").limit(TERMS)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("place", "term")))  # at most TERMS rows
    plain = everyday.select(F.col("word").alias("t")).distinct().withColumn("common", F.lit(True))
    out = ranked.join(plain, "t", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    return out.withColumns({"sounds": T.sounds("t"), "spine": T.skeleton("t"), "words": F.size(F.split("term", r"\s+")), "letters": F.length("t")})


def _keys(*parts: tuple[str, Column, Column]) -> Column:
    """The keys of several rules: (rule, condition, array of texts)."""

    def named(rule: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(rule), v))

    return F.concat(*[F.when(when, named(rule, values)).otherwise(F.array().cast("array<string>")) for rule, when, values in parts])


def _term_keys(terms: DataFrame) -> DataFrame:
    loose, t = ~F.col("common"), F.col("t")
    alike = loose & (F.col("letters") >= ALIKE)
    return terms.withColumn("key", F.explode(_keys(
        ("0", F.col("letters") >= 3, F.array(t)),
        ("1", alike, shortened(t)),
        ("2", alike & (F.length("sounds") >= SOUNDS) & (F.length("spine") >= SPINE), F.array(_sound_key(F.col("sounds"), F.col("spine")))),
        ("3", loose & (F.col("letters") >= BURIED), shortened(t)),
        ("4", alike, F.array(F.concat(F.substring(t, 1, 2), F.lit(" "), F.col("spine")))),
    )))


def _sound_key(sounds: Column, spine: Column) -> Column:
    return F.concat_ws(" ", F.length(sounds).cast("string"), F.substring(spine, F.lit(2), F.length(spine)))


def runs(lines: DataFrame, widest: int, key: str = "line", text: str = "text") -> DataFrame:
    """Runs of up to ``widest`` words of each line, with what the rules ask: key, at (from 0), width, folded, raw, named, elided, tail.

    Several words are a run only with nothing but blanks between them and no single letter among them.
    """
    split = lines.select(F.col(key).alias("line"), F.regexp_extract_all(text, F.lit(_GAPPED), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(_GAPPED), F.lit(2)).alias("word"))
    split = split.withColumn("fold", F.transform("word", T.fold))
    # a row for each word holds the words that follow it, not the line's
    names = ("gap", "word", "fold")
    ahead = [F.slice(c, 1 + k, F.greatest(F.size(c) - k, F.lit(0))).alias(f"{c}{k}") for k in range(1, widest) for c in names]
    split = split.select("line", *names, *ahead)
    at = split.select("line", F.posexplode(F.arrays_zip(*split.columns[1:])).alias("at", "w")).select("line", "at", "w.*")
    before = F.regexp_replace("gap", r"[\s\p{Z}]+\z", "")
    bare = F.regexp_replace(before, "[" + "".join(f"\\{c}" for c in OPENERS) + r"]+\z", "")
    opens = F.col("gap").rlike(r"\n[\s\p{Z}]*\z") | ((bare == "") & (F.col("at") == 0)) | bare.rlike(rf"[{STOPS}]\z")
    head, tail = T.fold(F.regexp_extract("word", r"^(.*)['’]", 1)), T.fold(F.regexp_extract("word", r"['’]([^'’]*)$", 1))
    elided = F.col("word").rlike("['’]") & (head != "") & (F.length(head) <= 5) & (F.length(tail) >= 3)
    at = at.withColumns({"named": F.col("word").rlike(r"^\p{Lu}") & ~opens, "elided": elided})

    def run(width: int) -> Column:
        parts = [F.lit(width).alias("width"), F.concat(*[f"fold{k or ''}" for k in range(width)]).alias("folded"), F.concat("word", *[f"{c}{k}" for k in range(1, width) for c in ("gap", "word")]).alias("raw")]
        if width == 1:
            return F.struct(*parts, F.col("named"), F.col("elided"), F.when(F.col("elided"), tail).alias("tail"))
        joined = F.col(f"word{width - 1}").isNotNull()
        for k in range(width):
            joined = joined & (F.length(f"fold{k or ''}") >= 2) & (F.col(f"gap{k}").rlike(r"^(?:(?![\r\n])[\s\p{Z}])*\z") if k else F.lit(True))
        return F.when(joined, F.struct(*parts, F.lit(False).alias("named"), F.lit(False).alias("elided"), F.lit(None).cast("string").alias("tail")))

    return at.select("line", "at", F.explode(F.array(*map(run, range(1, widest + 1)))).alias("r")).where("r is not null").select("line", "at", "r.*")


def claims(found: DataFrame, terms: DataFrame, everyday: DataFrame, octets: bool = False) -> DataFrame:
    """What the terms claim of the runs: line, at, width, rank, place, term.

    Edits are counted in characters, with ``octets`` in bytes. Words within one edit in bytes are so in
    characters (an edit that leaves other bytes of a character alone leaves no text), so both meet by the same keys.
    """
    word, single, letters = F.col("folded"), F.col("width") == 1, F.length("folded")
    near = single & (letters >= WORD)
    known = terms.select("t", "letters", "common").collect()  # TERMS rows at most
    loose = [r.letters for r in known if not r.common]
    buried, alike = ([n for n in loose if n >= least] for least in (BURIED, ALIKE))

    def sized(lengths: list[int], below: int, above: int) -> Column:
        """Whether a run is as long as a rule lets it be: most are not, and need no keys."""
        return letters.between(min(lengths) + below, max(lengths) + above) if lengths else F.lit(False)

    starts = F.substring(word, 1, 2).isin(sorted({r.t[:2] for r in known}))
    ends = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda i: shortened(F.substring(word, i, letters))))
    keyed = found.withColumn("key", F.explode(F.array_distinct(_keys(
        ("0", word.isin([r.t for r in known]), F.array(word)),
        ("1", near & sized(alike, -1, 1), shortened(word)),
        ("2", near & sized(alike, -2, 2) & F.col("named"), F.array(_sound_key(T.sounds("folded"), T.skeleton("folded")))),
        ("3", near & sized(buried, 1, 3) & (F.col("named") | F.col("elided")), ends),
        ("4", ~single & (letters >= WORD) & sized(alike, -3, 3) & starts, F.array(F.concat(F.substring(word, 1, 2), F.lit(" "), T.skeleton("folded")))),
    ))))
    met = keyed.join(F.broadcast(_term_keys(terms)), "key").withColumn("rule", F.substring("key", 1, 1).cast("int")).drop("key").distinct()
    t, size, other = F.col("t"), F.abs(letters - F.col("letters")), word != F.col("t")
    spine, sound = T.skeleton("folded"), T.sounds("folded")
    misheard = (size <= 2) & (F.length(sound) == F.length("sounds")) & (F.length(spine) == F.length("spine")) & (F.substring(spine, 1, 1) != F.substring("spine", 1, 1))
    held = (F.col("rule") == 0) & (F.col("raw") != F.col("term"))
    for rule, fits in ((1, size <= 1), (2, misheard), (3, (letters > F.col("letters")) & (letters <= F.col("letters") + 3) & tail_distance(t, word, octets=octets)), (4, size <= 3)):
        held = held | ((F.col("rule") == rule) & other & fits)
    kept = met.where(held)
    plain = everyday.select(F.col("word")).distinct()
    # what only the few runs that came this far need to know
    kept = kept.join(plain.select(F.col("word").alias("folded"), F.lit(True).alias("plain")), "folded", "left").join(plain.select(F.col("word").alias("tail"), F.lit(True).alias("plain_tail")), "tail", "left")
    free = F.col("plain").isNull()
    kept = kept.where((F.col("rule") == 0) | ((F.col("rule") == 3) & free) | (F.col("rule").isin(1, 2) & free & F.col("plain_tail").isNull()) | (F.col("rule") == 4))
    seen = T.octets if octets else T.col
    far = F.when(F.col("rule").isin(1, 4), T.damerau_distance(seen("folded"), seen("t"))).otherwise(0)
    kept = kept.withColumn("far", far).where(F.col("far") <= F.when(F.col("rule") == 1, 1).otherwise(3))
    return kept.select("line", "at", "width", F.when(F.col("rule") == 4, 2).otherwise(F.col("rule")).alias("rank"), "place", "term")


def chosen(found: DataFrame) -> DataFrame:
    """line and ``repairs``: each place's widest, then tightest, then first claim, from left to right without overlap."""
    best = found.groupBy("line", "at").agg(F.min(F.struct((-F.col("width")).alias("less"), "rank", "place", "term")).alias("b"))
    rows = best.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("b.less")).alias("width"), F.col("b.term").alias("term")))).alias("all"))
    start = F.struct(F.lit(0).alias("free"), F.slice("all", 1, 0).alias("kept"))
    take = lambda acc, c: F.when(c["at"] >= acc["free"], F.struct((c["at"] + c["width"]).alias("free"), F.array_append(acc["kept"], c).alias("kept"))).otherwise(acc)
    return rows.select("line", F.aggregate("all", start, take, lambda acc: acc["kept"]).alias("repairs"))


def repaired(lines: DataFrame, terms: DataFrame, everyday: DataFrame, text: str = "text", term: str = "term", place: str = "place", octets: bool = False) -> DataFrame:
    """``lines`` with ``repaired`` (the text put right) and ``changes`` (array of was and now, in order; empty where nothing changed).

    Every character that no claim covers stays where it is. Equal lines are repaired once and alike. A
    null line stays null, an empty one empty; without lines or terms nothing changes. Columns of these names give way. Long lines are
    cut into as many rows as they have runs, not kept whole in one.
    """
    known = glossary(terms, everyday, term, place)
    names = known.collect()  # TERMS rows at most
    known = lines.sparkSession.createDataFrame(names, known.schema)
    widest = max((r.words + (r.letters >= ALIKE) for r in names), default=0)
    if not widest:
        return lines.withColumns({"repaired": F.col(text), "changes": F.expr("cast(array() as array<struct<was string, now string>>)")})
    key, kept = "_line of repairs", "_repairs of line"
    rows = lines.withColumn(key, F.sha2(F.col(text), 256))
    taken = chosen(claims(runs(rows, widest, f"`{key}`", text), known, everyday, octets))
    out = rows.join(taken.select(F.col("line").alias(key), F.col("repairs").alias(kept)), key, "left")
    # columns of their own: a lambda would take the line apart for each of its words
    parts = ["_gaps of line", "_words of line", "_both of line"]
    taken_apart = {c: F.when(F.col(kept).isNotNull(), F.regexp_extract_all(text, F.lit(_GAPPED), F.lit(i))) for i, c in enumerate(parts[:2], 1)}
    out = out.withColumns(taken_apart).withColumn(parts[2], F.zip_with(*parts[:2], lambda g, w: F.concat(g, w)))
    gaps, words, both = map(F.col, parts)
    tail = F.substring(F.col(text), F.length(F.array_join(both, "")) + 1, F.length(text))

    def stretch(r: Column) -> Column:
        inner = F.slice(both, r["at"] + 2, r["width"] - 1)
        return F.concat(F.get(words, r["at"]), F.array_join(inner, ""))

    def put(acc: Column, r: Column) -> Column:
        between = F.array_join(F.slice(both, acc["next"] + 1, r["at"] - acc["next"]), "")
        return F.struct(F.concat(acc["done"], between, F.get(gaps, r["at"]), r["term"]).alias("done"), (r["at"] + r["width"]).alias("next"))

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("next"))
    new = F.aggregate(kept, start, put, lambda acc: F.concat(acc["done"], F.array_join(F.slice(both, acc["next"] + 1, F.size(both)), ""), tail))
    none = F.expr("cast(array() as array<struct<was string, now string>>)")
    changes = F.coalesce(F.transform(kept, lambda r: F.struct(stretch(r).alias("was"), r["term"].alias("now"))), none)
    return out.withColumns({"repaired": F.when(F.col(kept).isNull(), F.col(text)).otherwise(new), "changes": changes}).drop(key, kept, *parts)


def _alone(word: Column) -> Column:
    """A pattern for ``word`` with no letter or digit at either side."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(word, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}])"))


def reverted(text: str | Column, changes: str | Column) -> Column:
    """The line as it was before ``changes``; null if it can't be told.

    That is the case without changes, and where a replacement stands in the line more or less often
    than it was made: then a later hand has been there, or one of them was said.
    """
    line, log = T.col(text), T.col(changes)
    sure = F.forall(log, lambda c: (c["now"] != "") & (F.regexp_count(line, _alone(c["now"])) == F.size(F.filter(log, lambda d: d["now"] == c["now"]))))
    # what is done, the letter before what is left, what is left
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), line.alias("rest"))

    def step(acc: Column, c: Column) -> Column:
        seen = F.concat(acc["last"], acc["rest"])
        at = F.regexp_instr(seen, F.concat(F.when(acc["last"] == "", "").otherwise("(?<!^)"), _alone(c["now"]))) - F.length(acc["last"])
        return F.when(at < 1, F.struct(F.lit(None).cast("string").alias("done"), F.lit("").alias("last"), acc["rest"].alias("rest"))).otherwise(
            F.struct(F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), at - 1), c["was"]).alias("done"), F.substring(c["now"], -1, 1).alias("last"), F.substring(acc["rest"], at + F.length(c["now"]), F.length(acc["rest"])).alias("rest"))
        )

    return F.when((F.size(log) > 0) & sure, F.aggregate(log, start, step, lambda acc: F.concat(acc["done"], acc["rest"])))
