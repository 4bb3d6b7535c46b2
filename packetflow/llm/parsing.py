"""Addresses and names taken apart into the components that comparisons work on."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from packetflow.llm.editing import osa

#: Street types, directions, place words and states with their usual short forms.
STREET_TYPES = {
    "STREET": ("ST", "STR", "STRT"), "AVENUE": ("AVE", "AV", "AVN"), "ROAD": ("RD",), "LANE": ("LN", "LA"), "DRIVE": ("DR", "DRV"), "COURT": ("CT", "CRT"), "PLACE": ("PL", "PLC"), "BOULEVARD": ("BLVD", "BVD", "BLV"),
    "HIGHWAY": ("HWY", "HIWAY", "HIGHWY"), "TERRACE": ("TER", "TERR"), "TURNPIKE": ("TPKE", "TPK", "TRNPK"), "WAY": ("WY",), "CIRCLE": ("CIR",), "PARKWAY": ("PKWY",), "SQUARE": ("SQ",),
}
DIRECTIONS = {"NORTH": ("N", "NO", "NTH"), "SOUTH": ("S", "SO", "STH"), "EAST": ("E",), "WEST": ("W",)}
PLACE_WORDS = {"FORT": ("FT",), "MOUNT": ("MT",), "SAINT": ("ST",), "LAKE": ("LK",), "TOWNSHIP": ("TWP", "TWNSHP"), "JUNCTION": ("JCT", "JCTN"), "HEIGHTS": ("HTS", "HGTS", "HGHTS"), "SPRINGS": ("SPGS", "SPRS"), "FALLS": ("FLS",), "MILLS": ("MLS",), "PARK": ("PK", "PRK"), "NORTH": ("N", "NO"), "SOUTH": ("S", "SO"), "EAST": ("E",), "WEST": ("W",)}
STATES = {"NJ": "NEW JERSEY", "NY": "NEW YORK", "PA": "PENNSYLVANIA", "CT": "CONNECTICUT", "DE": "DELAWARE", "MD": "MARYLAND", "MA": "MASSACHUSETTS", "VA": "VIRGINIA", "FL": "FLORIDA", "CA": "CALIFORNIA", "TX": "TEXAS", "OH": "OHIO", "NC": "NORTH CAROLINA"}

_TYPE = {s: t for t, shorts in STREET_TYPES.items() for s in (t, *shorts)}
_DIRECTION = {s: d for d, shorts in DIRECTIONS.items() for s in (d, *shorts)}
_PLACE = {s: p for p, shorts in PLACE_WORDS.items() for s in shorts}
STATE_SHORTS = {"CONN": "CT", "PENN": "PA", "PENNA": "PA", "DEL": "DE", "MASS": "MA", "N J": "NJ", "N Y": "NY", "N.J": "NJ", "N.Y": "NY", "FLA": "FL", "CALIF": "CA", "TEX": "TX"}
_STATE = {n: c for c, n in STATES.items()} | {c: c for c in STATES} | STATE_SHORTS
_UNIT = re.compile(r"(?:\b(?:APARTMENT|APT|UNIT|UN|SUITE|STE|FLOOR|FLR|FL|ROOM|RM|BLDG|NUMBER|NO)\b\.?|#)\s*\.?#?\s*([0-9]+\s?[A-Z]?|[A-Z][0-9]*)\b")
_BOX = re.compile(r"\b(?:P\W*O\W*|POST\s+OFFICE\s+|PO)?\s*B[O0]X\s*#?\s*(\w+)")
_STATE_NAMES = "|".join(re.escape(n) for n in sorted(_STATE, key=len, reverse=True))
_TAIL = re.compile(rf"^\s*([A-Z][A-Z0-9.' ]+?)(?:[\s,]+({_STATE_NAMES})\.?)?(?:[\s,]+([0-9]{{5}})(?:-[0-9]+)*)?$")
_PLACEHOLDER = re.compile(r"^\W*(?:N/?A|NONE|NULL|UNKNOWN|TBD|SEE ATTACHED|SAME)?\W*$")


@lru_cache(maxsize=100_000)
def upper(text: str | None) -> str:
    """Upper case without accents, single spaces."""
    if not text:
        return ""
    if not text.isascii():
        text = text.replace("\u2019", "'").replace("\u2018", "'").replace("\u00b4", "'")
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.upper().split())


def letters(word: str) -> str:
    """A word with digits that stand for letters read as letters."""
    if word.isalpha() or word.isdigit():
        return word
    if len(word) > 3 and sum(c.isdigit() for c in word) in (1, 2) and not word[0].isdigit() or len(word) > 4 and sum(c.isdigit() for c in word) == 1 and not word[-1].isdigit() and not word[:-1].isdigit():
        return word.translate(str.maketrans("01568", "OISBB"))
    return word


def place(text: str | None) -> str:
    """A town with its words written out."""
    words = [letters(w) for w in re.findall(r"[A-Z0-9']+", upper(text).replace("'", ""))]
    return " ".join(_PLACE.get(w, w) if not (w == "ST" and i) else w for i, w in enumerate(words))


class Address(NamedTuple):
    number: str
    direction: str
    name: str
    kind: str
    city: str
    state: str
    zip: str


@lru_cache(maxsize=50_000)
def address(street: str | None, city: str | None, state: str | None, zip_: str | None) -> Address | None:
    """The components of an address without its unit; None when there is neither a number nor a box."""
    s, c, st, z = upper(street), upper(city), upper(state), upper(zip_)
    if _PLACEHOLDER.match(s):
        return None
    if _PLACEHOLDER.match(c) and "," in s:  # town, state and zip written after the street
        head, tail = s.rsplit(",", 1)
        if (m := _TAIL.match(tail)) and (m[2] or m[3]) and (re.search("[0-9].*[A-Z]{2}|[A-Z]{2}.*[0-9]", head) or "BOX" in head):
            s, c, st, z = head, m[1], st or m[2] or "", z or m[3] or ""
    digits = re.sub(r"[^0-9]", "", z.split("-")[0])
    st = _STATE.get(st.rstrip("."), _STATE.get(re.sub(r"[^A-Z ]", "", st), re.sub(r"[^A-Z]", "", st)))
    town = "" if _PLACEHOLDER.match(c) else place(c)
    if m := _BOX.search(s):
        return Address("BOX " + m[1], "", "", "", town, st, digits)
    s = _UNIT.sub(" ", s)
    words = [letters(w) for w in re.findall(r"[A-Z0-9]+", s.replace("'", ""))]
    numbers = [i for i, w in enumerate(words) if re.fullmatch(r"[0-9]+[A-Z]?", w) and w[:-1].isdigit() | w.isdigit()]
    if not numbers:
        return None
    at = numbers[0] if numbers[0] == 0 else numbers[-1]
    number = words.pop(at)
    direction = kind = ""
    if len(words) > 1 and words[0] in _DIRECTION:
        direction = _DIRECTION[words.pop(0)]
    if len(words) > 1:
        kind = _TYPE.get(words[-1]) or next((t for t in STREET_TYPES if len(words[-1]) >= 4 and t.startswith(words[-1])), "") or next((t for t in STREET_TYPES if len(words[-1]) >= 4 and osa(words[-1], t, 2) <= (1 if len(t) < 6 else 2)), "")
        if kind:
            words.pop()
    if len(words) > 1 and not direction and words[-1] in _DIRECTION:
        direction = _DIRECTION[words.pop()]
    return Address(number.lstrip("0") or "0", direction, " ".join(words), kind, town, st, digits)


#: Short forms of given names.
NICKNAMES = {
    "WILLIAM": "BILL BILLY WILL WILLIE LIAM", "ROBERT": "BOB BOBBY ROB ROBBIE BERT", "RICHARD": "DICK RICH RICK RICKY", "MARGARET": "MAGGIE MEG PEGGY MARGE MARGIE", "ELIZABETH": "LIZ BETH BETTY BETSY LIZZIE ELIZA", "REBECCA": "BECKY BECCA", "ANTHONY": "TONY", "NATHANIEL": "NAT NATE NATHAN",
    "STEVEN": "STEVE STEPHEN", "MICHAEL": "MIKE MICKEY MICK", "JOSEPH": "JOE JOEY", "JAMES": "JIM JIMMY JAMIE", "JOHN": "JACK JOHNNY", "CHARLES": "CHUCK CHARLIE CHAS", "EDWARD": "ED EDDIE TED NED", "THOMAS": "TOM TOMMY", "KATHERINE": "KATE KATHY KATIE KAT", "PATRICIA": "PAT PATTY TRICIA TRISH", "JENNIFER": "JEN JENNY",
    "DANIEL": "DAN DANNY", "MATTHEW": "MATT", "ANDREW": "ANDY DREW", "BENJAMIN": "BEN BENNY", "FREDERICK": "FRED FREDDY FREDDIE", "FRANCISCO": "PACO FRANK PANCHO", "GREGORY": "GREG", "KENNETH": "KEN KENNY", "LAWRENCE": "LARRY LAURENCE", "RONALD": "RON RONNIE", "SUSAN": "SUE SUSIE SUZY", "TIMOTHY": "TIM TIMMY",
    "THEODORE": "THEO TEDDY", "ALEXANDER": "ALEX SANDY XANDER SASHA", "ABIGAIL": "ABBY GAIL", "CHRISTINE": "CHRIS TINA CHRISSY", "CYNTHIA": "CINDY", "DEBORAH": "DEB DEBBIE", "JACQUELINE": "JACKIE", "VICTORIA": "VICKY VICKI TORI", "VERONICA": "RONNI VERO", "ZACHARY": "ZACH ZACK", "GUADALUPE": "LUPE LUPITA", "JOSE": "PEPE", "DOLORES": "LOLA", "VALENTINA": "VAL", "SAMUEL": "SAM SAMMY", "SAMANTHA": "SAM SAMMY", "DAVID": "DAVE", "PETER": "PETE", "DONALD": "DON", "PAMELA": "PAM",
}
_NICK: dict[str, list[str]] = {}
for _g, _ns in NICKNAMES.items():
    for _n in _ns.split():
        _NICK.setdefault(_n, []).append(_g)
TITLES = frozenset("MR MRS MS DR MISS REV ESQ PROF SRA".split())
SUFFIXES = frozenset("JR SR II III IV".split())
PARTICLES = frozenset("VAN DE DEL DER EL LA LE VON DA DI MC MAC ST".split())
#: Kinds of firm, with short forms of their words and whole abbreviations.
FIRM_KINDS = ("VEHICLE LEASING TRUST", "FEDERAL CREDIT UNION", "FINANCE SERVICES", "EQUIPMENT LEASING", "NATIONAL BANK", "BANK NA", "SAVINGS BANK", "MOTORS CREDIT", "AUTO FINANCE", "TRUCK AUTO", "CAR CENTER", "AUTO GROUP", "AUTO SALES", "AUTO MALL", "AUTOMALL", "CREDIT UNION", "AUTO", "IMPORTS", "MOTORS", "BANK", "LEASING", "FINANCE")
_KINDS = [(k, k.split()) for k in FIRM_KINDS]
SAME_KIND = {"BANK NA": "NATIONAL BANK", "AUTOMALL": "AUTO MALL"}
FIRM_WORDS = {
    "VEHICLE": ("VEH", "VEHICLES"), "LEASING": ("LSG", "LEASE", "LEAS"), "TRUST": ("TR", "TRST"), "FEDERAL": ("FED", "FEDL"), "CREDIT": ("CR", "CRED"), "UNION": ("UN", "UNI"), "SERVICES": ("SVC", "SVCS", "SERV", "SERVS", "SERVICE"), "EQUIPMENT": ("EQUIP", "EQPT", "EQP"),
    "NATIONAL": ("NATL", "NAT", "NTL"), "BANK": ("BK", "BNK"), "SAVINGS": ("SVGS", "SAV", "SVG", "SAVING"), "FINANCE": ("FIN", "FINCE", "FINANCIAL", "FINL", "FNCL"), "TRUCK": ("TRK", "TRUCKS"), "CENTER": ("CTR", "CNTR", "CENTRE"), "GROUP": ("GRP", "GP"), "SALES": ("SLS", "SALE"), "MALL": ("ML",), "IMPORTS": ("IMP", "IMPTS", "IMPORT"), "MOTORS": ("MTRS", "MTS", "MOTOR", "MTR", "MOT"), "AUTO": ("AUT", "AUTOS", "AUTOMOTIVE", "AUTOMTV", "ATMTV"), "CAR": ("CARS",),
}
_FIRM_WORD = {s: w for w, shorts in FIRM_WORDS.items() for s in (w, *shorts)}
FIRM_ACRONYMS = {"FCU": "FEDERAL CREDIT UNION", "VLT": "VEHICLE LEASING TRUST", "AF": "AUTO FINANCE", "MC": "MOTORS CREDIT", "NB": "NATIONAL BANK", "SB": "SAVINGS BANK", "EL": "EQUIPMENT LEASING", "FS": "FINANCE SERVICES", "AG": "AUTO GROUP", "AM": "AUTO MALL", "AS": "AUTO SALES", "CC": "CAR CENTER", "TA": "TRUCK AUTO"}
LEGAL = frozenset("LLC INC CORP CO COMPANY INCORPORATED CORPORATION LTD LIMITED LP LLP PLC".split())
_ADDED = re.compile(r"\(.*?\)|\s-\s.*$|\b(?:ISAOA|ATIMA|TITLE DEPT|LEASE DESK|LOAN DEPT|MAIN OFFICE|TITLE DEPARTMENT|DL COPY ON FILE)\b.*$|^(?:OWNER|NAME|LIENHOLDER|DEALER|LESSEE)\s*:")
_FIRM = re.compile(r"\b(?:LLC|INC|CORP|CO|COMPANY|INCORPORATED|CORPORATION|BANK|BK|CREDIT|FCU|VLT|MOTORS?|MTRS?|AUTO|AUTOMOTIVE|IMPORTS?|LEASING|LSG|FINANCE|FINANCIAL|TRUST|CENTER|CTR|UNION)\b")


class Name(NamedTuple):
    """kind: of firm, empty for people. block and text are what is compared by edit distance; initial and extra what a
    shorter writing leaves open: a person's given initial and suffix, a firm's name without its town."""

    kind: str
    given: str
    initial: str
    middle: str
    suffix: str
    text: str
    core: str
    town: str


def _dotless(text: str) -> str:
    return re.sub(r"\b((?:[A-Z]\.){2,})", lambda m: m[1].replace(".", "") + " ", text)


def is_firm(text: str) -> bool:
    return bool(_FIRM.search(_dotless(upper(text))))


@lru_cache(maxsize=50_000)
def _firm_word(w: str) -> str:
    if w in _FIRM_WORD:
        return _FIRM_WORD[w]
    if len(w) >= 5:
        near = [x for x in (*FIRM_WORDS, "AUTOMOTIVE", "FINANCIAL") if len(x) >= 5 and osa(w, x, 1) <= 1]
        if near:
            return _FIRM_WORD[near[0]]
    return w


def _town(text: str, towns: frozenset[str]) -> str:
    """A known town for one written out or misspelled."""
    found = place(text)
    if not found or found in towns or len(found) < 5:
        return found
    near = sorted((osa(found, t, 2), t) for t in towns if abs(len(t) - len(found)) <= 2 and osa(found, t, 2) <= 2)
    return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else found


town_of = lru_cache(maxsize=20_000)(_town)


def firm_name(text: str, city: str | None, towns: frozenset[str] = frozenset()) -> Name | None:
    s = _ADDED.sub(" ", _dotless(upper(text)).replace("&", " ").replace("'", "").replace(" AND ", " "))
    s = re.sub(r"\b([A-Z])/([A-Z])\b", r"\1\2", s)
    words = [w for w in (letters(w) for w in re.findall(r"[A-Z0-9]+", s)) if w != "THE"]
    while words and words[-1] in LEGAL:
        words.pop()
    town = ""
    if "OF" in words[1:]:
        at = len(words) - 1 - words[::-1].index("OF")
        town = town_of(" ".join(w for w in words[at + 1 :] if w not in LEGAL), towns)
        words = words[:at]
    words = [x for w in words if w not in LEGAL for x in (("CREDIT", "UNION") if w == "CU" else (w,))]
    plain = [_firm_word(w) for w in words]
    kind = ""
    for k, parts in _KINDS:
        if parts[0] not in plain:
            continue
        spots = [i for i in range(len(plain) - len(parts) + 1) if plain[i : i + len(parts)] == parts]
        if spots and len(words) > len(parts):
            kind = SAME_KIND.get(k, k)
            words = words[: spots[-1]] + words[spots[-1] + len(parts) :]
            break
    else:
        if words and words[-1] in FIRM_ACRONYMS and len(words) > 1:
            kind = FIRM_ACRONYMS[words.pop()]
    if not words:
        return None
    if not town:
        town = town_of(city, towns) if city else ""
        for n in range(min(4, len(words) - 1), 0, -1):  # the town may stand first
            first = place(" ".join(words[:n]))
            if first in towns or town and abs(len(first) - len(town)) <= 2 and osa(first, town, 2) <= 2:
                town, words = first if first in towns else town, words[n:]
                break
    return Name(kind or "FIRM", "", "", "", "", "".join(words), "", town)


def firm_town(text: str, city: str | None) -> list[str]:
    """The towns a firm's name and address write, for counting."""
    m = re.search(r"\bOF ([A-Z .']+)", _ADDED.sub(" ", _dotless(upper(text))))
    found = [" ".join(w for w in place(m[1]).split() if w not in LEGAL)] if m else []
    return [t for t in (*found, place(city)) if len(t) > 3]


@lru_cache(maxsize=50_000)
def _given(word: str, pool: frozenset[str]) -> str:
    """The full given name a word means, or the word."""
    if word in _NICK:  # of several names, the one in use here
        return next((g for g in _NICK[word] if g in pool), _NICK[word][0])
    if word in pool or len(word) < 4:
        return word
    near = sorted((osa(word, g, 2), g) for g in pool if abs(len(g) - len(word)) <= 1 and osa(word, g, 1 if len(word) < 7 else 2) <= (1 if len(word) < 7 else 2))
    return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else word


@lru_cache(maxsize=50_000)
def _unclear(word: str, pool: frozenset[str]) -> bool:
    """Not a known given name, but a misspelling of more than one."""
    return len(word) > 2 and _given(word, pool) not in pool and any(abs(len(g) - len(word)) <= 1 and osa(word, g, 1) <= 1 for g in pool)


def given_candidates(text: str) -> str:
    """The word that stands where a given name stands, for counting."""
    s = _ADDED.sub(" ", upper(text)).replace("'", "")
    head, comma, tail = s.partition(",")
    if comma and re.findall("[A-Z]+", tail) and re.findall("[A-Z]+", tail)[0] not in SUFFIXES:
        s = tail
    words = [w for w in re.findall(r"[A-Z]+", s) if w not in TITLES]
    return words[0] if words and len(words[0]) > 2 else ""


def person_name(text: str, pool: frozenset[str]) -> Name | None:
    s = re.sub(r"&.*$", "", _ADDED.sub(" ", upper(text))).replace("'", "").replace("-", "")
    suffix = ""
    head, comma, tail = s.partition(",")
    words = lambda x: [w if w.isalpha() else letters(w) for w in re.findall(r"[A-Z0-9]+", x) if w not in TITLES]
    left, right = words(head), words(tail)
    for part in (left, right):
        for w in [w for w in part if w in SUFFIXES]:
            suffix = w
            part.remove(w)
    if comma and right:
        last, given = left, right
    else:
        found = left + right
        if len(found) < 2:
            return Name("", "", "", "", suffix, "".join(found), "", "") if found else None
        first, second = _given(found[0], pool), _given(found[1], pool)
        if first not in pool and len(found[0]) > 1 and not _unclear(found[0], pool) and second in pool:
            cut = 1
            last, given = found[:cut], found[cut:]
        elif first not in pool and len(found[0]) > 1 and found[0] in PARTICLES and len(found) > 2 and _given(found[2], pool) in pool:
            last, given = found[:2], found[2:]
        else:
            cut = 1
            if len(found) > 2 and found[1] not in PARTICLES and (len(found[1]) == 1 or second in pool):
                cut = 2
            last, given = found[cut:], found[:cut]
    if not last or not given:
        return None
    name = _given(given[0], pool) if len(given[0]) > 1 and not _unclear(given[0], pool) else ""
    return Name("", name, given[0][0] if not name else name[0], given[1][0] if len(given) > 1 else "", suffix, "".join(last), "", "")
