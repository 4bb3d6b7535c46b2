"""Template residue, filler, error pages and script notices (p9).

Texts are cut into segments (lines and sentences); numbers, codes, dates and addresses in them are masked, and equal masked
segments are grouped by hash over all documents, with the documents and sources that carry them. A group that recurs is
a message when its wording has the shape of one: a cue (error, expired, javascript, placeholder ...) and hardly a word
beside those that machines, browsers and templates use. Sentences that speak about such things name people, places and
papers as well and have another shape. Some wordings and placeholders have no other reading and count wherever they stand.

What a segment could be depends on its masked words alone, so segments without a cue and without a placeholder are left out
before they are grouped; only hashes leave their task, texts are never shuffled, and a hash that millions of documents
carry is combined before the shuffle.

Results for odd input: null, empty and blank texts are not residue; texts are read whole, however long; a null source
is a source of its own; repeated rows give one row per document; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packetflow.llm.words import _WORD, folded, plain, words
from packetflow.session import cut_lineage

#: A message counts when at least so many documents of so many sources carry it.
RECURS_DOCUMENTS, RECURS_SOURCES = 3, 2
#: Share of a message's words (function words aside) that machines, browsers and templates use; with one cue all of them.
SHAPED = 0.75

#: Cues by kind, English and Spanish, without accents.
CUES = {
    "script": "javascript script scripts scripting noscript cookie cookies navegador browser",
    "error": "error errors exception fatal traceback denied forbidden unavailable unauthorized timeout timed expired failed failure failing unexpected invalid overloaded maintenance oops sorry wrong gateway http https status server again reload refresh retry robot captcha traffic rights permission loading moved gone crashed offline unreachable caducado caducada denegado encontrada encontrado movido cargando intente intentelo servidor",
    "filler": "lorem ipsum placeholder dummy sample filler blah asdf qwer copy paragraph wording heading relleno sustituya parrafo",
}
#: Other words of messages.
USUAL = frozenset(
    """please try later soon back start home return exist exists longer requested asked open opened opening load loaded loads view viewed viewer see page pages site website web link address url app application form screen window service services system portal
    image record records content text body box letter closing title header line one two three few call called null undefined empty object java lang php view run main message kind code unusual network tick show slow down list second seconds minute minutes hour moment waiting while out support supports supported
    blocks block require requires required capable turned turn switch on only need needs starts allowed allow enable enabled disable disabled activate appear something went side here final will test user name password log login sign session access do does did not no can cannot could must may you your we our us
    contact administrator request requests internal bad found many too most recent last process processed processing complete completed connection connect database time limit reached temporarily temporary currently problem problems issue trouble document file files handle handled store stored click go
    activar active habilite habilitar debe ver formulario pagina inicio iniciar sesion vuelva nuevo contenido texto documento acceso existe ya no su por favor mas tarde""".split()
)
#: Function words, which tell nothing.
FUNCTION = frozenset("a an the this that these it its is are was were be been being has have had to of for in at by with from as if and or so there than up el la los las un una de del en con para que se al este esta".split())

#: Wordings with no other reading; ^ and $ bind to the ends of a segment, # stands for a number.
SCRIPT_NOTICES = (
    "^noscript", "^please enable javascript", "^please turn on javascript", "^you need to enable javascript", "^enable javascript to", "^javascript is required", "^javascript is disabled", "^javascript must be enabled", "needs scripts turned on", "your browser has scripting disabled", "your browser is out of date or blocks scripts",
    "^cookies and scripts must be allowed", "^debe activar javascript", "^active javascript para", "^habilite javascript",
)
ERROR_PAGES = (
    "^access denied$", "you do not have permission to access", "^acceso denegado$", "^oops something went wrong", "something went wrong on our side", "^service unavailable$", "^service temporarily unavailable", "^your session has expired", "^session expired$", "^su sesion ha caducado", "^pagina no encontrada", "^page not found$", "fue movido o ya no existe",
    "^too many requests$", "we detected unusual traffic from your network", "^fatal error", "^traceback most recent call last", "nullpointerexception", "^http status #", "the page you asked for could not be", "the server could not return what was asked for", "the server could not serve what was asked for", "the server could not find what was asked for",
    "^# not found$", "^# forbidden$", "^# gone$", "^# bad gateway$", "^# unavailable$", "^# service unavailable$", "^# internal server error$", "^# gateway timeout", "^error #", "^internal server error$", "^bad gateway$", "^gateway timed out",
)
FILLER = ("your text goes here", "your heading goes here", "^sample text$", "^sample text replace", "^texto de relleno", "^this is dummy copy", "^this is dummy text", "^type the body of the letter", "^type the closing", "blah blah blah", "asdf asdf", "qwer qwer", "lorem ipsum")
#: Stems of filler Latin.
LATIN = ("lorem", "ipsum", "dolor", "sit", "amet", "consect", "adipis", "elit", "sed", "eiusmod", "tempor", "incidid", "labor", "magna", "aliqu", "enim", "minim", "veniam", "quis", "nostru", "exerci", "ullamc", "nisi", "commod", "conseq", "duis", "aute", "irure", "repreh", "volupt", "velit", "esse", "cillum", "fugiat", "nulla", "pariat", "except", "sint", "occaec", "cupid", "proid", "sunt", "culpa", "offici", "deseru", "mollit", "anim", "laborum", "dolore", "est")
#: Words that name fields of letters and forms.
FIELD_WORDS = frozenset("vin owner name first last full amount price total due date sale sold lienholder lender lien clerk plate no number dealer dealership city state zip street address buyer seller customer phone email make model year color odometer document title county account signature insert enter here your the recipient sender company".split())

_FIELD = r"[A-Za-z][A-Za-z_ .]*?"
#: Placeholders whose brackets alone show them.
_SURE = re.compile(r"\{\{\s*[^{}\n]+\}\}|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|\{%=?[^%{}\n]+%\}|<%=?[^%<>\n]+%>|@@[A-Za-z][\w ]*@@|\[\[\s*[A-Za-z][^\[\]\n]*\]\]|\[object object\]|#ref!|#value!|#name\?|#n/a|error! reference source not found|\[(?:insert|enter) [^\[\]\n]+\]|(?<![\w%])%[sd](?![\w%])|\{[0-9]\}", re.I)
#: Placeholders only with a field's name inside.
_NAMED = re.compile(rf"<<\s*({_FIELD})\s*>>|<({_FIELD})>|\[({_FIELD})\]|\{{({_FIELD})\}}|«\s*({_FIELD})\s*»|‹\s*({_FIELD})\s*›|##({_FIELD})##|%%?({_FIELD})%%?|(?<![A-Za-z0-9])XX({_FIELD})XX(?![A-Za-z0-9])|(?<!_)__({_FIELD})__(?!_)")
_LABEL = re.compile(r"(?m)^[ \t>*-]*(?:[A-Za-zÁÉÍÓÚáéíóúñ][A-Za-zÁÉÍÓÚáéíóúñ ]{1,24}:|Dear|DEAR|dear|Hello|Hi|Estimad[oa]|ESTIMAD[OA])[ \t]*\$?(undefined|UNDEFINED|null|NULL|None|NONE|NaN|nan|NAN|TODO|todo|nil|NIL|\(string\)|\(STRING\)|\(null\)|\(NULL\))[ \t]*[,.;]?[ \t]*$|\$(?:undefined|UNDEFINED|null|NULL|NaN|NAN|None|NONE|TODO)\b")
_BROKEN = ("undefined", "null", "none", "nan", "todo", "nil", "error!")
#: Sentences that speak about a marker instead of leaving one unfilled.
_ABOUT = re.compile(r"\b(?:mail merge|marker|letter temp\w+|do not delete)\b", re.I)
_DIGIT = re.compile("[0-9]")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_DATE = re.compile(r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b")
_ADDRESS = re.compile(r"\b\d+\s+(?:[A-Z][\w']*\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Boulevard|Blvd|Highway|Hwy|Terrace|Ter|Turnpike|Tpke|Way)\b\.?", re.I)
#: A code has two digits or is a number; a word with one digit in it is a misread word.
_CODE = re.compile(r"\b(?=\w*\d\w*\d)[\w-]+\b|\b\d+\b")


def _rules(phrases: tuple[str, ...]) -> re.Pattern:
    """One pattern over the folded words of a segment, put between blanks."""
    parts = []
    for p in phrases:
        inner = " ".join("#" if w == "#" else folded(plain(w)) for w in p.strip("^$").split())
        parts.append(("^ " if p.startswith("^") else " ") + re.escape(inner) + (" $" if p.endswith("$") else ""))
    return re.compile("|".join(parts))


KINDS = (("script", _rules(SCRIPT_NOTICES)), ("error", _rules(ERROR_PAGES)), ("filler", _rules(FILLER)))
_CUE = {folded(w): kind for kind, text in CUES.items() for w in text.split()}
_USUAL = frozenset(folded(w) for w in USUAL) | _CUE.keys()
_FUNCTION = frozenset(folded(w) for w in FUNCTION)
_LATIN = re.compile("(?:" + "|".join(folded(s) for s in LATIN) + r")\w*$")


def masked(segment: str) -> str:
    """The segment's folded words with dates, addresses, codes and numbers masked."""
    text = _CODE.sub(" \x01 ", _ADDRESS.sub(" \x02 ", _DATE.sub(" \x01 ", segment)))
    found = []
    for part in re.split("([\x01\x02])", text):
        found += ["#" if part == "\x01" else "@"] if part in ("\x01", "\x02") else words(part)
    return " ".join(found)


def shape(mask: str) -> str | None:
    """The kind of message a masked segment has the shape of."""
    tokens = [w for w in mask.split() if w not in _FUNCTION and w not in "#@"]
    found = {_CUE[w]: w for w in tokens if w in _CUE}
    if not found:
        return None
    share = sum(w in _USUAL for w in tokens) / len(tokens)
    if share < 1 and (share < SHAPED or len({w for w in tokens if w in _CUE}) < 2):
        return None
    return next(kind for kind in CUES if kind in found)


def has_placeholder(text: str) -> bool:
    """An unfilled placeholder or a broken value where content belongs."""
    if "&" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&laquo;", "«").replace("&raquo;", "»")
    if not any(c in text for c in "{[<«‹%@#(") and "__" not in text and "XX" not in text and not any(w in text.lower() for w in _BROKEN):
        return False
    if _SURE.search(text) or _LABEL.search(text):
        return True
    for m in _NAMED.finditer(text):
        inner = next(g for g in m.groups() if g)
        parts = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", inner)} | set(re.findall("[a-z]+", inner.lower()))
        named = set(re.findall("[a-z]+", inner.lower()))
        if named <= FIELD_WORDS or {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", inner)} <= FIELD_WORDS or _compound(named):
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            before = max(start, text.rfind(". ", 0, m.start()) + 1)
            if parts and not _ABOUT.search(text[before : end if end >= 0 else len(text)]):
                return True
    return False


def _compound(named: set[str]) -> bool:
    """Each word is two field words written as one, as in saledate."""
    return all(w in FIELD_WORDS or any(w[:i] in FIELD_WORDS and w[i:] in FIELD_WORDS for i in range(2, len(w) - 1)) for w in named)


def _core(phrase: str) -> str:
    return " ".join(folded(plain(w)) for w in phrase.strip("^$").split() if w != "#")


#: Messages that may run over line ends, so looked for in the whole text.
_ANYWHERE = {_core(p): kind for kind, phrases in (("script", SCRIPT_NOTICES), ("error", ERROR_PAGES), ("filler", FILLER)) for p in phrases if p[0] != "^" and p[-1] != "$" and "#" not in p and len(p.split()) >= 3}


class Reader:
    """The rules with what makes them fast: one automaton over all wordings, and a bounded memory of words."""

    def __init__(self, most: int = 200_000):
        import ahocorasick

        self.triggers = ahocorasick.Automaton()
        for p in (*SCRIPT_NOTICES, *ERROR_PAGES, *FILLER):
            core = _core(p)
            self.triggers.add_word(f" {core} ", core)
        self.triggers.make_automaton()
        self.known: dict[str, tuple[str, int, int, int, int]] = {}
        self.most = most

    def fold(self, text: str) -> tuple[str, int, int, int, int]:
        """The folded words of plain text, and how many are filler Latin, cues, words of messages and other words (function words aside)."""
        if len(self.known) > self.most:
            self.known.clear()
        known, found, latin, cues, usual, other = self.known, [], 0, 0, 0, 0
        for w in _WORD.findall(text):
            if (x := known.get(w)) is None:
                f = folded(w)
                x = known[w] = (f, int(bool(_LATIN.match(f))), int(f in _CUE), int(f in _USUAL and f not in _FUNCTION), int(f not in _USUAL and f not in _FUNCTION))
            found.append(x[0])
            latin += x[1]
            cues += x[2]
            usual += x[3]
            other += x[4]
        return " ".join(found), latin, cues, usual, other

    def segments(self, text: str) -> Iterator[tuple[str, str, bool]]:
        """(kind, masked segment, sure) of the segments that can be a message; sure ones count without recurring."""
        if has_placeholder(text):
            yield "placeholder", "", True
        pieces = [(p, self.fold(p)) for p in _CUT.split(plain(text)) if p]
        hits = {core for _, core in self.triggers.iter(f" {' '.join(x[0] for _, x in pieces if x[0])} ")}
        for core in hits:
            if core in _ANYWHERE:
                yield _ANYWHERE[core], "", True
        every = hits or sum(x[1] for _, x in pieces) >= 5
        seen = set()
        for piece, (_, _, cues, usual, other) in pieces:
            # Without digits nothing is masked, so the words already tell that it has no shape.
            if not every and (not cues or usual < SHAPED * (usual + other) and not _DIGIT.search(piece)):
                continue
            if (mask := masked(piece)) in seen or not mask:
                continue
            seen.add(mask)
            padded, tokens = f" {mask} ", mask.split()
            kind = next((k for k, rule in KINDS if rule.search(padded)), None)
            if kind is None and len(tokens) >= 5 and sum(bool(_LATIN.match(w)) for w in tokens) >= 0.6 * len(tokens):
                kind = "filler"
            if kind:
                yield kind, mask, True
            elif kind := shape(mask):
                yield kind, mask, False


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, hash, sure): every segment that can be a message, as the hash of its masked form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        reader = Reader()
        for b in batches:
            out = []
            for doc_id, source, text in zip(b.doc_id, b.source, b.text):
                out += [(doc_id, source, kind, xxhash.xxh64_intdigest(mask) - 2**63, sure) for kind, mask, sure in dict.fromkeys(reader.segments(text))]
            yield pd.DataFrame(out, columns=["doc_id", "source", "kind", "hash", "sure"])

    rows = documents.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "text").filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return rows.mapInPandas(run, "doc_id bigint, source string, kind string, hash bigint, sure boolean")


def groups(found: DataFrame) -> DataFrame:
    """(kind, hash, n_documents, n_sources, sure): equal masked segments over all documents."""
    each = found.groupBy("kind", "hash", "source", "doc_id").agg(F.max("sure").alias("sure")).groupBy("kind", "hash", "source").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    return each.groupBy("kind", "hash").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_sources"), F.max("sure").alias("sure"))


def recurs(found: DataFrame) -> DataFrame:
    """The groups that recur over documents and sources; rules that look at the whole text have no hash of their own."""
    return groups(found).filter((F.col("n_documents") >= RECURS_DOCUMENTS) & (F.col("n_sources") >= RECURS_SOURCES))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds array<string>) of the documents to leave out."""
    found = cut_lineage(messages(documents))  # read twice below
    recurring = found.filter("not sure").join(recurs(found.filter("not sure")).select("kind", "hash"), ["kind", "hash"], "left_semi")
    rows = found.filter("sure").select("doc_id", "kind").unionByName(recurring.select("doc_id", "kind"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def found_residue(documents: DataFrame) -> DataFrame:
    return residue(documents).select("doc_id")


def clean(documents: DataFrame) -> DataFrame:
    """The corpus without residue, all columns kept."""
    return documents.join(found_residue(documents), "doc_id", "left_anti")
