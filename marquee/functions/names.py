"""Names of artists and promoters: text scanners without a built-in equivalent.

Each is a small Python function and a pandas UDF over Arrow batches. Names repeat, so a batch
computes each distinct one once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

# Words kept in capitals, words that promoters' names end with, corrected names,
# letters without a decomposition.
ACRONYMS = frozenset("DJ MC VJ UK US USA FM AM TV EP LP NYC LA EDM DIY RIP FKJ AZ DBG JC".split())
COMPANY_WORDS = frozenset(
    "gmbh mbh ug gbr kg ohg ag ev ou oü ltd llc inc co concert concerts konzert konzerte music musik events event booking agency agentur promotion promotions "
    "entertainment live records production productions prsnt prsnts presenting präsentiert präsentieren".split()
)
ARTIST_CORRECTIONS = {"oxo86": "Oxo 86"}
PROMOTER_CORRECTIONS = {
    "trinty": "Trinity", "radioactve": "Radioactive", "allrooms": "All Rooms", "loft": "Loft Concerts", "fluxfm": "FluxFM", "radioeins": "radioeins",
    "tipberlin": "tip Berlin", "kkt": "KKT", "kktgmbhkikiskleinertourneeservice": "KKT",
}
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ß": "ss", "ẞ": "Ss", "œ": "oe", "Œ": "Oe"})


def shouted(word: str) -> bool:
    return any(map(str.isalpha, word)) and word == word.upper() and not any(c.islower() for c in word)


def calm(word: str) -> str:
    """The word with its first letter in upper and the others in lower case."""
    at = next((i for i, c in enumerate(word) if c.isalpha()), None)
    return word if at is None else word[: at + 1].upper() + word[at + 1 :].lower()


def key(name: str, letters: str) -> str:
    return re.sub(f"[^a-z0-9{letters}]", "", name.lower())


def artist(name: str) -> str:
    """Words in capitals are calmed, but for acronyms, words with digits, dots or slashes, and a
    name of one or two capitals."""
    tokens = name.split()
    if len(tokens) == 1 and len(tokens[0]) <= 2 and shouted(tokens[0]) and not re.search(r"\d", tokens[0]):
        out = tokens[0]
    else:
        out = " ".join(calm(t) if shouted(t) and t.upper() not in ACRONYMS and not re.search(r"[\d./]", t) else t for t in tokens)
    return ARTIST_CORRECTIONS.get(key(out, "äöüßø"), out)


def _company(word: str) -> bool:
    return key(word, "äöüß") in COMPANY_WORDS | {""}


def promoter(name: str) -> str:
    """The name without a bracketed note and company words at its end; a word with letters stays."""
    name = name.strip()
    tokens = (re.sub(r"\s*\([^)]*\)\s*$", "", name).strip() or name).split()
    while len(tokens) > 1 and _company(tokens[-1]) and any(c.isalpha() for t in tokens[:-1] for c in t):
        tokens.pop()
    out = " ".join(t[0] + t[1:].lower() if len(t) >= 2 and shouted(t) else t for t in tokens)
    return PROMOTER_CORRECTIONS.get(key(out, "äöüß"), out)


def is_no_promoter(name: str) -> bool:
    return all(map(_company, re.sub(r"\s*\([^)]*\)\s*$", "", name.strip()).split()))


def slug(text: str) -> str:
    """A slug of any Latin text: letters lose their marks, the rest becomes dashes."""
    plain = unicodedata.normalize("NFKD", text.translate(LETTERS))
    plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")


def _udf(f: Callable[[str], object], kind: DataType):
    @F.pandas_udf(kind)
    def run(names: pd.Series) -> pd.Series:
        known = {x: f(x) for x in names.dropna().unique()}
        return pd.Series([known.get(x) for x in names], dtype=object)

    return run


artist_udf, promoter_udf, slug_udf = (_udf(f, StringType()) for f in (artist, promoter, slug))
