"""Free-typed values to the entry of a reference list they mean (p3).

Token-level repair: the distinct tokens of all distinct values are joined to the vocabulary of the reference list by edit
distance (deletion keys find the pairs, the distance decides), abbreviations enter the vocabulary as short forms of its
words, and the repaired tokens are combined by soft TF-IDF to rank complete entries. Words that occur beside three or
more different entries (or are listed as such) are context and weigh next to nothing, so "1 set ... plates" or
"... metallic" do not dilute a match while unknown words do. Only distinct values and distinct tokens are compared; a
value that fills a third of the table is one row after the map-side combine.

Results for odd input: null and blank values are no values; a value no entry explains is reported with canonical_id 0;
ties go to the entry met more often as typed exactly in the data, then to the smaller id; tokens longer than the longest word plus the
allowed edits cannot match and are only counted as unexplained; an empty reference list gives 0 for all; repeated rows
are one value; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packetflow.functions.text import strip
from packetflow.llm.editing import deletion_keys, osa, skeleton, squeeze_runs
from packetflow.session import cut_lineage, spread

FIELDS = ("vehicle_color", "driver_eyes_color", "vehicle_make", "plate_type")
EDITS = 2
#: Score from which an entry counts as meant.
THRESHOLD = 0.6
#: Words in common use for an entry that reference lists leave out (field, word, canonical).
SYNONYMS = (
    ("vehicle_color", "JET", "BLACK"), ("vehicle_color", "NEGRO", "BLACK"), ("vehicle_color", "BLANCO", "WHITE"), ("vehicle_color", "ROJO", "RED"), ("vehicle_color", "AZUL", "BLUE"),
    ("vehicle_color", "GREY", "GRAY"), ("vehicle_color", "CHARCOAL", "GRAY"), ("vehicle_color", "PLATEADO", "SILVER"), ("vehicle_color", "NARANJA", "ORANGE"), ("vehicle_color", "DORADO", "GOLD"), ("vehicle_color", "MARRON", "BROWN"),
    ("vehicle_color", "MORADO", "PURPLE"), ("vehicle_color", "VINO", "MAROON"), ("vehicle_color", "NAVY", "BLUE"), ("vehicle_color", "CREAM", "BEIGE"), ("vehicle_color", "TEAL", "TURQUOISE"), ("vehicle_color", "TURQUESA", "TURQUOISE"), ("vehicle_color", "BRONCE", "BRONZE"),
    ("driver_eyes_color", "CAFE", "BROWN"), ("driver_eyes_color", "AZUL", "BLUE"), ("driver_eyes_color", "VERDE", "GREEN"), ("driver_eyes_color", "AVELLANA", "HAZEL"), ("driver_eyes_color", "GREY", "GRAY"), ("driver_eyes_color", "GRIS", "GRAY"), ("driver_eyes_color", "NEGRO", "BLACK"), ("driver_eyes_color", "MULTI", "DICHROMATIC"),
    ("vehicle_make", "BL TRUCKS", "BRENLAND"),
    ("plate_type", "MOVE PLATES", "TRANSFER PLATES"), ("plate_type", "TRUCK PLATES", "COMMERCIAL"), ("plate_type", "COURTESY", "VANITY"), ("plate_type", "TITLE ONLY", "NO PLATES"), ("plate_type", "TAXI", "LIVERY"),
)
#: Words that go with any entry of a field.
CONTEXT = {
    "vehicle_color": ("METALLIC", "MET", "PEARL", "DARK", "DK", "LIGHT", "LT", "TONE", "CLEARCOAT", "COLOR", "CODE", "EXT", "INT", "CLOTH"),
    "driver_eyes_color": ("EYE", "EYES", "DARK", "DK", "LIGHT", "LT"),
    "vehicle_make": ("USA", "INC", "DIV", "IMPORT", "MAKE", "MOTORS", "TRUCK", "NEW"),
    "plate_type": ("REQUEST", "REQ", "PLS", "CUSTOMER", "WANTS", "SET", "RUSH", "MAIL", "OUT", "PASSENGER", "X1"),
}
#: Words beside several entries of one list are a vocabulary; more than this many would be no vocabulary any more.
CONTEXT_MOST = 100_000
#: Words that stand for no value; they are never taken for a misspelling.
NO_VALUE = frozenset({"UNK", "UNKNOWN", "TBD", "NA", "NOT", "SEE", "SAME", "YES", "PENDING", "CARD", "CLASS", "CUSTOM", "WRAP", "ASK", "SHOWN", "LISTED", "GLASSES", "SEDAN", "SPORT", "TRAILER"})
#: Endings that leave the meaning of a word as it is.
ENDINGS = ("ISH",)


def tokens(value: str) -> list[str]:
    return re.findall(r"[A-Z0-9]+", value.upper())


def splittings(words: list[str]) -> list[list[str]]:
    """The words, and with one gap between neighbours moved by a letter or closed."""
    found = [words]
    if NO_VALUE.intersection(words) or any(re.search("[0-9]{2}", w) for w in words):  # codes are what they are
        return found
    for i in range(len(words) - 1):
        a, b, head, tail = words[i], words[i + 1], words[:i], words[i + 2 :]
        found.append([*head, a + b, *tail])
        found.append([*head, a + b[0], *([b[1:]] if b[1:] else []), *tail])
        found.append([*head, *([a[:-1]] if a[:-1] else []), a[-1] + b, *tail])
    return found


def _digits_read_as_letters(word: str) -> str:
    return word.translate(str.maketrans("015", "OIS")) if re.search("[A-Z]", word) else word


def _forms(word: str) -> dict[str, float]:
    """Ways to write a word of the vocabulary and how surely each means it: itself, cut short, without vowels."""
    found = {word: 1.0}
    if len(word) >= 4:
        for n in range(max(2, (len(word) + 1) // 2), len(word)):
            found.setdefault(word[:n], 0.85)
    if len(word) >= 3:
        bones = skeleton(word)
        for n in range(3, len(bones) + 1):
            found.setdefault(bones[:n], 0.85)
    if len(word) >= 4:
        for ending in ENDINGS:
            found.setdefault(word + ending, 0.9)
    return found


def allowed(word: str, sure: float) -> int:
    """Edits that still mean the word: fewer for short words and short forms."""
    if sure < 1:
        return 0 if len(word) < 3 else 1 if len(word) < 8 else EDITS
    return 0 if len(word) < 3 else 1 if len(word) == 3 else EDITS if len(word) < 9 else EDITS + 1


def reference_names(canonical: DataFrame) -> list[tuple[str, int, tuple[str, ...]]]:
    """(field, id, words) of every accepted name. The list is a reference of fixed size and is checked to be small."""
    rows = canonical.select("field_name", "canonical_id", "canonical", "also_known").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("the reference list has more than 20,000 entries; split it by field")
    found = []
    for r in rows:
        if r.field_name is None or r.canonical_id is None:
            continue
        extra = [w for f, w, c in SYNONYMS if f == r.field_name and c == (r.canonical or "").upper()]
        for name in (r.canonical, *(r.also_known or ()), *extra):
            if name and (words := tokens(name)):
                found.append((r.field_name, r.canonical_id, tuple(words)))
    return list(dict.fromkeys(found))


def distinct_values(extractions: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field_name, raw_value, n): every non-blank value of the fields once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.value").alias("raw_value")) for f in fields])
    long = extractions.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("raw_value").isNotNull() & (strip("raw_value") != ""))
    return long.groupBy("field_name", "raw_value").agg(F.count("*").alias("n"))


def _vocabulary(names, context: dict[str, set[str]]) -> dict[str, dict[str, list[tuple[str, float]]]]:
    """field -> written form -> [(word, sureness)]; a joined name of several words is a word as well."""
    words: dict[str, set[str]] = defaultdict(set)
    for field, _, name in names:
        words[field] |= {*name, "".join(name)}
    out = {}
    for field in {*words, *context}:
        forms: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for w in sorted(words[field]):
            for form, sure in _forms(w).items():
                forms[form].append((w, sure))
        for f, _, name in names:
            if f == field and len(name) > 1 and len(short := "".join(skeleton(" ".join(name))[:3].split())) > 1:
                forms[short].append(("".join(name), 0.85))
        for w in sorted(context.get(field, set()) - words[field]):
            forms[w].append((w, 1.0))
        out[field] = dict(forms)
    return out


def _token_rows(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {(f, t) for f, v in zip(b.field_name, b.raw_value) for s in splittings(tokens(v)) for t in s}
            yield pd.DataFrame(sorted(seen), columns=["field_name", "token"])

    return values.select("field_name", "raw_value").mapInPandas(run, "field_name string, token string").distinct()


def repaired_tokens(tokens_df: DataFrame, vocabulary: dict[str, dict[str, list[tuple[str, float]]]]) -> DataFrame:
    """(field_name, token, word, sim): distinct tokens joined to vocabulary words by edit distance through deletion keys."""
    spark = tokens_df.sparkSession
    longest = {f: max(map(len, forms), default=0) + EDITS + 1 for f, forms in vocabulary.items()}
    rows = [(f, key, form, word, sure) for f, forms in vocabulary.items() for form, ws in forms.items() for word, sure in ws for key in deletion_keys(form, allowed(form, sure))]
    widest = {f: max((allowed(form, sure) for form, ws in forms.items() for _, sure in ws), default=0) for f, forms in vocabulary.items()}
    sure_words = {f: {form for form, ws in forms.items() if any(sure == 1 for _, sure in ws)} for f, forms in vocabulary.items()}
    # A joined name and the words in it: who leaves out a word means what is left, not the name with a few edits.
    inside = {(f, w): found for f, ws in sure_words.items() for w in ws if allowed(w, 1.0) > EDITS and (found := [p for i in range(len(w)) for j in range(i + 3, len(w) + 1) if (p := w[i:j]) != w and p in ws])}
    vocab = spark.createDataFrame(rows, "field_name string, key string, form string, word string, sure double") if rows else spark.createDataFrame([], "field_name string, key string, form string, word string, sure double")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, t in zip(b.field_name, b.token):
                if len(t) <= longest.get(f, 0) and t not in NO_VALUE:
                    shapes = {t, _digits_read_as_letters(t), squeeze_runs(t)}
                    # Words that allow more than EDITS have nine letters or more, so what is within EDITS + 1 of them has six.
                    out += [(f, t, k) for k in {k for s in shapes for k in deletion_keys(s, widest[f] if len(s) >= 6 else min(EDITS, widest[f]))}]
            yield pd.DataFrame(out, columns=["field_name", "token", "key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, t, form, word, sure in zip(b.field_name, b.token, b.form, b.word, b.sure):
                most = allowed(form, sure)
                d = min(osa(t, form, most), osa(_digits_read_as_letters(t), form, most) + 0.1)
                doubled = len(form) > 1 and squeeze_runs(t) == squeeze_runs(form)
                if d > most and doubled:
                    d = 1
                if d > EDITS and any(osa(t, p, EDITS) <= EDITS for p in inside.get((f, form), ())):
                    continue
                if d <= most or doubled:
                    out.append((f, t, word, sure * (1 - d / (len(form) + 2))))
            yield pd.DataFrame(out, columns=["field_name", "token", "word", "sim"])

    keyed = spread(tokens_df, "field_name", "token").mapInPandas(keys, "field_name string, token string, key string")
    pairs = keyed.join(vocab, ["field_name", "key"]).select("field_name", "token", "form", "word", "sure").distinct()
    return pairs.mapInPandas(verify, "field_name string, token string, word string, sim double").groupBy("field_name", "token", "word").agg(F.max("sim").alias("sim"))


def context_words(values: DataFrame, names, least: int = 3) -> DataFrame:
    """(field_name, token) of words beside names of at least least different entries, from all distinct values."""
    exact: dict[tuple, int] = {(f, *w): i for f, i, w in names}
    longest = max((len(w) for _, _, w in names), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for f, v in zip(b.field_name, b.raw_value):
                t = tokens(v)
                for i in range(len(t)):
                    for j in range(i + 1, min(len(t), i + longest) + 1):
                        if (hit := exact.get((f, *t[i:j]))) is not None:
                            out |= {(f, x, hit) for x in (*t[:i], *t[j:])}
            yield pd.DataFrame(sorted(out), columns=["field_name", "token", "canonical_id"])

    beside = values.select("field_name", "raw_value").mapInPandas(run, "field_name string, token string, canonical_id int")
    return beside.groupBy("field_name", "token").agg(F.countDistinct("canonical_id").alias("entries")).filter(F.col("entries") >= least).select("field_name", "token")


def _rank(value: str, repairs: dict[str, list[tuple[str, float]]], names, index: dict[str, list[int]], weights: dict[str, float], context: set[str], order: dict[int, float]) -> tuple[int, float]:
    """The best entry of a value by soft TF-IDF over repaired tokens, and its score; only entries with a repaired word are looked at."""
    best = (0, 0.0)
    base = tokens(value)
    for words in splittings(base):
        moved = 0.0 if words is base else 0.02
        found = [dict(repairs.get(t, ())) for t in words]
        is_context = [max((s for w, s in c.items() if w in context), default=0.0) for c in found]
        for at_name in {n for c in found for w, sim in c.items() if sim > 0 for n in index.get(w, ())}:
            cid, name, joined = names[at_name]
            for target in (name, (joined,)) if len(name) > 1 else (name,):
                used, got, whole = set(), 0.0, 0.0
                for w in target:
                    weight = weights.get(w, 1.0) if target is name else 1.5
                    whole += weight
                    sim, at = max(((c.get(w, 0.0), -i) for i, c in enumerate(found) if i not in used), default=(0.0, 0))
                    if sim > 0:
                        used.add(-at)
                        got += weight * sim
                if not used:
                    continue
                rest = sum(0.03 if is_context[i] >= 0.7 else 1.0 if len(t) > 2 and re.search("[0-9]", t) and re.search("[A-Z]", t) else 0.08 if is_context[i] > 0 or len(t) == 1 and t.isdigit() else 0.25 if len(t) == 1 else 1.0 for i, t in enumerate(words) if i not in used)
                score = got / whole * (whole / (whole + rest)) - moved
                if (score, order.get(cid, 0.0), -cid) > (best[1], order.get(best[0], 0.0), -best[0]):
                    best = (cid, score)
    return best if best[1] >= THRESHOLD else (0, best[1])


def map_values(extractions: DataFrame, canonical: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field_name, raw_value, canonical_id int, score double, n bigint) for every distinct non-blank value."""
    names = reference_names(canonical)
    values = cut_lineage(distinct_values(extractions, fields))
    context: dict[str, set[str]] = {f: set(CONTEXT.get(f, ())) for f in fields}
    known = {(f, w) for f, _, name in names for w in name}
    beside = context_words(values, names).limit(CONTEXT_MOST + 1).collect()
    if len(beside) > CONTEXT_MOST:
        raise ValueError(f"more than {CONTEXT_MOST} words go with several entries")
    for r in beside:
        if (r.field_name, r.token) not in known:
            context[r.field_name].add(r.token)
    vocabulary = _vocabulary(names, context)
    repairs = repaired_tokens(_token_rows(values), vocabulary)

    by_field: dict[str, list] = defaultdict(list)
    for f, i, name in names:
        by_field[f].append((i, name, "".join(name)))
    index: dict[str, dict[str, list[int]]] = {f: defaultdict(list) for f in by_field}
    for f, rows in by_field.items():
        for n, (_, name, joined) in enumerate(rows):
            for w in {*name, joined}:
                index[f][w].append(n)
    weights: dict[str, dict[str, float]] = {}
    for f, rows in by_field.items():
        df = Counter(w for _, name, _ in rows for w in set(name))
        weights[f] = {w: math.log(1 + len(rows) / n) / math.log(1 + len(rows)) for w, n in df.items()}
    typed = {(f, "".join(w)): i for f, i, w in names}

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, v, n, t) for f, v, n in zip(b.field_name, b.raw_value, b.n) for t in sorted({t for s in splittings(tokens(v)) for t in s} or {""})]
            yield pd.DataFrame(out, columns=["field_name", "raw_value", "n", "token"])

    exact = values.groupBy("field_name", F.regexp_replace(F.upper("raw_value"), "[^A-Z0-9]", "").alias("plain")).agg(F.sum("n").alias("n"))
    exact = exact.join(values.sparkSession.createDataFrame([(f, p) for f, p in typed] or [("", "")], "field_name string, plain string"), ["field_name", "plain"], "left_semi")
    order: dict[str, dict[int, float]] = defaultdict(dict)
    for r in exact.collect():  # at most one row per reference name
        order[r.field_name][typed[(r.field_name, r.plain)]] = order[r.field_name].get(typed[(r.field_name, r.plain)], 0) + r.n

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, v, n, found in zip(b.field_name, b.raw_value, b.n, b.found):
                repairs_of: dict[str, list[tuple[str, float]]] = defaultdict(list)
                for x in found:
                    repairs_of[x["token"]].append((x["word"], x["sim"]))
                cid, score = _rank(v, repairs_of, by_field.get(f, []), index.get(f, {}), weights.get(f, {}), context.get(f, set()), order.get(f, {}))
                out.append((f, v, cid, score, n))
            yield pd.DataFrame(out, columns=["field_name", "raw_value", "canonical_id", "score", "n"])

    exploded = values.mapInPandas(expand, "field_name string, raw_value string, n bigint, token string")
    joined = spread(exploded.join(repairs, ["field_name", "token"], "left"), "field_name", "raw_value")
    hit = F.when(F.col("word").isNotNull(), F.struct("token", "word", "sim"))
    grouped = joined.groupBy("field_name", "raw_value").agg(F.max("n").alias("n"), F.collect_list(hit).alias("found"))
    return grouped.mapInPandas(rank, "field_name string, raw_value string, canonical_id int, score double, n bigint")
