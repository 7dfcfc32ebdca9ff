"""Content and link features of a page, for telling running text from keywords, links and tags."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# Small words that sentences need and keyword lists lack, of the corpus's languages.
SMALL = frozenset(
    "a an and are as at be been before but by can did do does for from had has have he her his if in into is it its no not of off on once one or our out over so some such "
    "than that the their them then there these they this to up us was we were what when where which while who why will with would yet you your near until after since "
    "der die das den dem des ein eine einen einer und oder aber ist sind war waren wird wurde wurden werden hat haben nicht nur auf aus bei bis durch für im in ins mit nach "
    "noch um unter von vom vor wie wir zu zum zur über als auch an am sich so es er sie dass weil wenn während "
    "el la los las un una unos unas y o pero es son fue fueron ha han hemos no con de del al en para por que se su sus lo le como más muy sin sobre entre cuando donde porque ya este esta "
    "le les des du et est sont dans pour par sur avec ne pas qui que il elle nous vous".split()
)
URL = re.compile(r"(?:https?:)?//[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+", re.I)
ANCHOR = re.compile(r"<a\b[^<>]*>.*?</a>|\[[^\[\]\n]{1,200}\]\([^()\s]{1,500}\)", re.I | re.S)
TAG = re.compile(r"<[!/]?[A-Za-z][^<>]*>")
WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
KANA = re.compile(r"[ぁ-ゟ]")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|[\r\n]+")
# Codes and prices of product lists; assignments, calls and brackets of code.
CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|for .*:$|if .*:$|while .*:$|[\w\[\].,]+\s+(?:=|\+=|-=)\s+\S|\w+\([^)]*\)\s*$|@\w+|#include|[{}();]+$)")
OFFER = re.compile(r"\b(?:sku|ref|art|item|no|nr|artikel|código|cod)\b\W{0,3}\d{3,}|\d+[.,]\d\d\s*$|\b(?:eur|usd|in stock|sale|new)\b|\*{3,}|[€$£]", re.I)
NUMBER = re.compile(r"[-+]?\d[\d.,:/]*(?:[eE][-+]?\d+)?%?")

NAMES = [
    "prose", "lines_of_links", "links_per_word", "link_chars", "offers", "code", "numbers", "small_words", "hashtags", "single_letters", "mixed_digits", "distinct",
    "top_words", "new_pairs", "separators", "words_a_segment", "listed", "kana", "log_words", "repeated", "lexicon_spread", "identifiers",
]


MIXED = re.compile(r"[a-z][0-9]+[a-z]|^[0-9]+[a-z]{2,}|[a-z]{3,}[0-9]$|[a-z][0-9]+[a-z]*[0-9]")
BREAKS = re.compile(r"</(?:li|p|div|tr|td|ul|ol|h\d)>|<br\s*/?>|<li\b[^<>]*>", re.I)

#: What is known of a word of letters: 0 a number, else bits: 1 always, 2 small, 4 a single letter, 8 letters and digits mixed. Forgotten when full.
_KINDS: dict[str, int] = {}


def _kind(word: str) -> int:
    k = _KINDS.get(word)
    if k is None:
        k = 0 if NUMBER.fullmatch(word) else 1 | 2 * (word in SMALL) | 4 * (len(word) == 1 and word.isalpha()) | 8 * bool(MIXED.search(word))
        if word.isalpha():  # numbers and codes hardly come again and would fill the store
            _KINDS[word] = k
    return k


def features(text: str | None) -> np.ndarray | None:
    """One row of NAMES for a text; None for a text without any word."""
    if not text:
        return None
    n_chars = max(1, len(text))
    if len(_KINDS) > 200_000:
        _KINDS.clear()
    linked = "//" in text or "www." in text or "](" in text or "<a" in text or "<A" in text
    anchors = ANCHOR.findall(text) if linked else []
    urls = URL.findall(text) if linked else []
    # Links become one mark, so that their parts are not taken for words.
    body = ANCHOR.sub(" \uffff ", text) if anchors else text
    link_chars = sum(map(len, anchors)) + (sum(map(len, URL.findall(body))) if urls else 0)
    if urls:
        body = URL.sub(" \uffff ", BREAKS.sub("\n", body))
    if "<" in body:
        body = TAG.sub(" ", BREAKS.sub("\n", body))
    segments = [s for s in SPLIT.split(body) if s and not s.isspace()]
    total = prose = links = offers = code = numbers = listed = singles = mixed = small = hashtags = separators = kana = ids = 0.0
    counts: Counter = Counter()
    pairs: set = set()
    for s in segments:
        plain = s.isascii()
        japanese = 0 if plain else len(CJK.findall(s))
        low = WORD.findall(s.lower())
        marks = 0 if plain else s.count("\uffff")
        size = len(low) + japanese / 3.0 + marks
        if not size:
            continue
        total += size
        kinds = list(map(_KINDS.get, low))
        if None in kinds:
            kinds = [_kind(t) for t in low]
        plain_numbers = kinds.count(0)
        letters = [t for t, k in zip(low, kinds, strict=True) if k] if plain_numbers else low
        # The kinds there are: 1 a word, 3 a small one, 5 a letter, 7 a small letter, 9 mixed.
        both = kinds.count(7)
        few, one = kinds.count(3) + both, kinds.count(5) + both
        numbers += plain_numbers
        small += few
        singles += one
        mixed += kinds.count(9)
        if "_" in s:
            ids += sum("_" in t for t in s.split())
        tags = s.count("#")
        hashtags += tags
        seps = s.count(",") + s.count(";") + s.count("/") + s.count("|") + s.count(">") + (0 if plain else s.count("•") + s.count("·"))
        separators += seps
        k = len(KANA.findall(s)) if japanese else 0
        kana += k
        counts.update(letters)
        pairs.update(zip(letters, letters[1:], strict=False))
        if japanese > 4 and k:
            # Japanese sentences join words by kana; lists of nouns have next to none.
            if k / japanese > 0.2:
                prose += size
            continue
        if CODE.match(s):
            code += size
        elif marks and marks * 3 >= len(low):
            links += size
        elif few <= 1 and len(low) <= 16 and len(letters) >= 2 and OFFER.search(s):
            offers += size
        elif len(letters) >= 3 and few / len(letters) >= 0.14 and one < 0.3 * len(low) and tags < 3 and len(set(letters)) > 0.5 * len(letters):
            prose += size
        elif letters and seps + 1 >= len(letters) / 3:
            listed += size
    if not total:
        return None
    n = sum(counts.values())
    top = sum(c for _, c in counts.most_common(8))
    return np.array([
        prose / total, links / total, (len(anchors) + len(urls)) / total, min(1.0, link_chars / n_chars), offers / total, code / total, numbers / total, small / total, hashtags / total,
        singles / total, mixed / total, len(counts) / max(1, n) ** 0.75, top / max(1, n), len(pairs) / max(1, n - 1), separators / total, total / max(1, len(segments)), listed / total,
        kana / n_chars, np.log1p(total), sum(c - 1 for c in counts.values() if c > 3) / max(1, n), len(counts) / max(1.0, total), ids / total,
    ])
