"""Genre tags of a listing's genre text.

The text is cut into tokens, and each token is looked up as a whole, then by its words; a token
that no synonym knows stays as written if it can be a genre at all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Synonyms by key (lower-case letters, digits and &), words that no genre holds,
# words of a genre at most, and phrases that end a token.
SYNONYMS = {
    "hiphop": "Hip Hop", "germanhiphop": "Hip Hop", "rap": "Hip Hop", "deutschrap": "Hip Hop", "urban": "Hip Hop", "experimentalhiphop": "Hip Hop", "trap": "Hip Hop",
    "rock": "Rock", "alternativerock": "Rock", "poprock": "Rock", "bluesrock": "Rock", "experimentalrock": "Rock", "rawknroll": "Rock", "garagernr": "Garage-Rock",
    "kraut": "Krautrock", "krautrock": "Krautrock", "alternative": "Alternative", "alternativeindie": "Alternative", "indie": "Indie", "indiepop": "Indie", "indierock": "Indie",
    "shoegaze": "Shoegaze", "pop": "Pop", "kpop": "K-Pop", "deutschpop": "Pop", "altpop": "Pop", "elektropop": "Pop", "queerpop": "Pop", "poppunk": "Punk",
    "synthpop": "Synthpop", "synth": "Synthpop", "punk": "Punk", "punkrock": "Punk", "emo": "Emo", "electropunk": "Electropunk", "elektropunk": "Electropunk",
    "metal": "Metal", "metalcore": "Metalcore", "melodichardcore": "Melodic-Hardcore", "hc": "Hardcore", "stonerpsychedelicmetal": "Metal",
    "electronic": "Electronic", "electronica": "Electronic", "elektrofusion": "Electronic", "synthesizerinstrumental&melodicelectronica": "Electronic",
    "techno": "Techno", "house": "House", "afrohouse": "House", "latinhouse": "House", "drumnbass": "Drum & Bass", "dnb": "Drum & Bass", "postpunk": "Post-Punk", "newwave": "New Wave",
    "darkwave": "Darkwave", "ebm": "EBM", "gothicrock": "Gothic Rock", "soul": "Soul", "neosoul": "Soul", "indiesoul": "Soul", "funk": "Funk", "boogaloo": "Funk",
    "r&b": "R&B", "rnb": "R&B", "altrnb": "R&B", "jazz": "Jazz", "jazzfusion": "Jazz", "latinjazz": "Jazz", "blues": "Blues", "folk": "Folk", "americana": "Americana",
    "singersongwriter": "Singer-Songwriter", "singersongwriterin": "Singer-Songwriter", "reggae": "Reggae", "reggea": "Reggae", "ndw": "NDW", "neuedeutschewelle": "NDW",
    "neuedeutschehrte": "Neue Deutsche Härte", "tango": "Tango", "cumbia": "Latin", "salsa": "Latin", "latin": "Latin", "latinroots": "Latin", "latinpop": "Latin", "reggaeton": "Latin",
    "merengue": "Latin", "bachata": "Latin", "afro": "Afrobeats", "afrobeat": "Afrobeats", "afrobeats": "Afrobeats", "world": "World Music", "worldmusic": "World Music",
    "global": "World Music", "indian": "World Music", "urdurock": "World Music", "disco": "Disco", "discotunes": "Disco", "karaoke": "Karaoke", "80s": "80s", "90s": "90s",
    "2000s": "2000s", "mod": "Mod", "oldschool": "Old School", "newschool": "New School",
}
NO_GENRES = frozenset(
    "special immersive ausstellung exhibition vernissage lesung reading party festival show konzert concert presents present podcast markt support openair warmup aftershow release "
    "releaseparty beyond wave retro nontango dirt groove progressive kickass flinta mnnerparty fetish berbenautika musikshow musikkabarett kabarett comedy tanz ballett diskussion kultur "
    "kunst tribute berlin anime".split()
)
MOST_WORDS = 2
TAILS = ("disco floor", "floor")
SPELLINGS = (
    (re.compile(r"\bdrum\s*['’]?\s*n\s*['’]?\s*bass\b|\bdrum\s*&\s*bass\b|\bdrum\s+and\s+bass\b|\bd\s*&\s*b\b|\bdnb\b", re.IGNORECASE), "Drum'n'Bass"),
    (re.compile(r"\bsinger[\s/-]*songwriter(in)?\b", re.IGNORECASE), "Singer-Songwriter"),
)
_CUT = re.compile(r"[,/]|\s(?:&|or|oder|vs)\s", re.IGNORECASE)


def key(text: str) -> str:
    return re.sub("[^a-z0-9&]", "", text.lower())


def tokens(text: str) -> list[str]:
    """Parts of a genre text, without etc. and what a floor adds."""
    for pattern, spelling in SPELLINGS:
        text = pattern.sub(spelling, text)
    out = []
    for part in _CUT.split(text):
        part = re.sub(r"(?i)\s+und\s+", ", ", re.sub(r"(?i)\s+etc\.?$", "", part.strip())).strip()
        for tail in TAILS:
            if part.lower().endswith(tail):
                part = part[: -len(tail)].strip()
        out += [p.strip() for p in part.split(",") if p.strip()]
    return out


def tags_of(token: str) -> list[str]:
    """The tags of one token, or none."""
    low = token.lower().strip()
    if len(low) < 2 or low.startswith("from "):
        return []
    if low.startswith("all kinds of"):
        first = low.removeprefix("all kinds of").strip().split(" ")[0]
        return [SYNONYMS[key(first)]] if key(first) in SYNONYMS else []
    words = low.split()
    known = [SYNONYMS[k] for k in ([key(low)] if key(low) in SYNONYMS else map(key, words)) if k in SYNONYMS]
    if known:
        return list(dict.fromkeys(known))
    if len(words) > MOST_WORDS or not NO_GENRES.isdisjoint([key(token), *map(key, words)]) or not any(map(str.isalpha, token)):
        return []
    return [" ".join(w[:1].upper() + w[1:] for w in token.split(" "))]


def tags(text: str) -> list[str]:
    """The distinct tags of a genre text, in its order."""
    return list(dict.fromkeys(t for token in tokens(text) for t in tags_of(token)))


@F.pandas_udf(ArrayType(StringType()))
def tags_udf(texts: pd.Series) -> pd.Series:
    known = {x: tags(x) for x in texts.dropna().unique()}
    return pd.Series([known.get(x) for x in texts], dtype=object)
