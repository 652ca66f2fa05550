"""The lemma cascade against plain top-down recursion, on worded cases and on random words."""

import functools
import random
import re

import pytest

from lectio.operators import lemmas as M

DICTIONARY = "word string, headwords array<struct<lemma:string,pos:string,root:string>>, splits array<string>"
ROWS = [
    ("dhamma", [("dhamma", "masc", None)], None), ("dhammaṃ", [("dhamma", "masc", None)], []), ("evaṃ", [("evaṃ", "ind", None)], None), ("loka", [("loka", "masc", None)], None),
    ("deseti", [("deseti", "pr", "√dis")], None), ("santi", [("sa", "adj", None), ("santi", "pr", None)], ["saṃ + iti"]), ("hotīti", [], ["hota + iti", "hoti + iti"]), ("hoti", [("hoti", "pr", None)], None),
    ("jānāti", [("ja", "adj", None), ("jānāti", "pr", None)], ["jānaṃ + iti"]), ("ñāṇa", [("ñāṇa", "nt", None)], None), ("agga", [("agga", "adj", None)], None), ("paṭhama", [("paṭhama", "ordin", None)], None),
    ("gacchāmi", [("gacchati", "pr", "√gam")], None), ("evan", [], []), ("satto", [("satta", "masc", None)], None), ("vicari", [("vicarati", "aor", None)], None), ("stub", None, None),
    ("labhāmā", [], ["labhaṃ + iti"]), ("labhāma", [("labhati", "pr", None)], None),
]
NAMES = ["gotama", "sujātā", "a b"]
CUSTOM = [("zzz", "z", "ind", None), ("yyyca", None, None, ["y", "loka"]), ("nolokaxyz", "n", "ind", None)]
RULES = [(0, "o", "a", "a", "a", 2), (1, "a", "d", "", "d", 3), (2, "m", "m", "mm", "", 4)]


def plain(word, rules=True):
    """(lemma, pos, root, parts, told lemmas) by recursion from the top, straight from the rules as stated."""
    words = {w: (h or [], s or []) for w, h, s in ROWS}
    short = lambda w: w.replace("ā", "a").replace("ī", "i").replace("ū", "u")
    soft = "aeiouāīū"

    def head(w):
        return words[w][0][0] if w in words and words[w][0] else None

    def comp(p, loose=False):
        h = head(p) or (head(short(p)) if loose else None)
        return h[0] if h else None

    def pick(key, w):
        listed = words.get(key, ([], []))[0]
        cites = {w, w[:-1] + short(w[-1])}
        if listed and listed[0][1] not in M.FINITE and listed[0][0] not in cites and w[-2:] in ("ti", "tī"):
            listed = [h for h in listed[1:] if h[1] == "pr" and h[0] in cites] + listed
        return (*listed[0], None, None) if listed else None

    def iti(host):
        made = {host[:-1] + "nti", host[:-1] + "miti"} if host[-1] == "ṃ" else {host + "ti", host + "iti"} if host[-1] in soft else set()
        made |= {host[:-1] + {"a": "ā", "i": "ī", "u": "ū"}[host[-1]] + "ti"} if host[-1] in "aiu" else set()
        return made | {m[:-1] + "ī" for m in made}

    def finite(w):
        return any(h[1] in M.FINITE for h in words.get(w, ([], []))[0])

    def direct(w):
        spelt = [w] + ([w[:-1] + "ṃ"] if w[-1] == "n" or w[-1] == "m" and len(w) > 1 else []) + [w[:-1] + short(w[-1])]
        key = next((k for k in spelt if k in words and (words[k][0] or words[k][1])), None)
        if key is None:
            return None
        cuts = [s.replace(" ", "").split("+") for s in words[key][1]]
        parts = None
        if cuts and cuts[0][1:] != ["iti"]:
            parts = cuts[0]
        elif cuts and not (w.endswith(("nti", "ntī")) and (finite(w) or finite(w[:-1] + "i"))):
            parts = next((c for c in cuts if c[1:] == ["iti"] and w in iti(c[0])), None)
        return (None, None, None, parts, [comp(p) for p in parts]) if parts else pick(key, w)

    def name(w):
        names = [n for n in NAMES if " " not in n]
        stems = {n[:-1]: n for n in names if n[-1] in "aā"}
        if w in names:
            return w
        for e in M.NAME_ENDINGS:
            if w.endswith(e) and len(w) > len(e) + 2:
                stem = w[: -len(e)]
                if stem in stems or stem + "a" in names:
                    return stems.get(stem, stem + "a")
        return None

    def with_base(base, part, told, front, lemma_only=False):
        b = find(base)
        if not b or (lemma_only and not b[0]):
            return None
        parts, lemmas = b[3] or [base], b[4] if b[3] else [b[0]]
        return (None, None, None, [part, *parts], [told, *lemmas]) if front else (None, None, None, [*parts, part], [*lemmas, told])

    def split(w, depth):
        best, least = None, 3 if len(w) >= 10 else 4
        ok = lambda p: p in words or short(p) in words
        for at in range(least, len(w) - least + 1):
            ways = [(w[:at], w[at:], 1)] + [(w[: at - 1] + c, d + w[at + 1 :], k) for _, a, b, c, d, k in RULES if (a, b) == (w[at - 1], w[at])]
            for x, y, k in ways:
                if min(len(x), len(y)) < least or not ok(x):
                    continue
                if ok(y):
                    got = ((-2, -k, min(len(x), len(y))), [x, y])
                else:
                    sub = split(y, depth - 1) if len(y) >= 2 * least and depth > 1 else None
                    got = sub and ((sub[0][0] - 1, sub[0][1] - k, min(len(x), sub[0][2])), [x, *sub[1]])
                if got and (best is None or got[0] > best[0]):
                    best = got
        return best

    @functools.cache
    def find(w):
        if not w:
            return None
        if w in M.ENGLISH:
            return (w, "eng", None, None, None)
        out = direct(w) or (M.PRONOUNS.get(w) and (M.PRONOUNS[w], "pron", None, None, None))
        if not out and w.endswith("ñcā") and len(w) > 3:
            out = with_base(w[:-3] + "ṃ", "ca", "ca", False)
        if not out:
            p = next((p for p in M.PARTICLES if w.endswith(p) and len(w) > len(p) + 1), None)
            if p:
                base = w[: -len(p)]
                out = with_base(base[:-1] + "ṃ" if p == "ca" and base.endswith("ñ") else base, p, M.PARTICLES[p], False)
        if not out and name(w):
            out = (name(w), "name", None, None, None)
        if not out and w.startswith("aham") and len(w) > 6:
            out = with_base(w[4:], "ahaṃ", "ahaṃ", True)
        elif not out:
            s = next((s for s in M.FUSED if w.endswith(s) and len(w) > len(s) + 2), None)
            out = s and with_base(w[: -len(s)] + s[0], s, "attā", False)
        for a, b in M.VERB_ENDINGS:
            if w.endswith(a):
                out = out or pick(w[: -len(a)] + b, w)
                break
        out = out or (pick(short(w), w) if short(w) != w else None)
        if not out and w in M.COMPOUNDS:
            out = (None, None, None, list(M.COMPOUNDS[w]), [comp(p) for p in M.COMPOUNDS[w]])
        for end, base in M.TITLES.items():
            if not out and w.endswith(end) and w != end:
                out = (w, "title", None, [w[: -len(end)], base], [None, base])
        elder = re.match(M.APADANA, w)
        if not out and elder:
            out = (w, "title", None, list(elder.groups()), [None, "therī" if "therī" in elder[2] else "thera", "apadāna"])
        if not out:
            for a, b in M.CAUSATIVES:
                stem = w[: -len(a)] if w.endswith(a) else ""
                hit = next((k for k in [stem + b] + [stem + e for e in M.BASE_ENDINGS if len(stem) > 3] if stem and k in words), None)
                if hit:
                    out = head(hit) and (head(hit)[0], "abs", head(hit)[2], None, None)
                    break
        if not out and w not in {c[0] for c in CUSTOM}:
            n, second, third = len(w), w[1:2], w[2:3]
            cases = [(5, w[:2] == "no", 2, 0), (5, w[:2] == "na" and third not in soft and w[3:4] == third, 3, 0), (5, w[:2] == "an" and third in soft, 2, n > 12), (6, w[:2] == "nā", 2, 0), (6, w[0] == "a" and second not in soft and third == second, 2, 1), (9, w[0] == "a" and second not in soft, 1, 1)]
            for least, holds, cut, lemma_only in cases:
                out = out or (with_base(w[cut:], "na", "na", True, lemma_only) if n >= least and holds else None)
            got = split(w, 4) if rules and not out and n >= 8 else None
            out = out or (got and (None, None, None, got[1], [comp(p, True) for p in got[1]]))
        for c in CUSTOM:
            if not out and c[0] == w:
                out = (None, None, None, c[3], [comp(p) for p in c[3]]) if c[3] else (c[1], c[2], None, None, None)
        return out or None

    return find(word)


@pytest.fixture(scope="module")
def lexicon(spark):
    dictionary = spark.createDataFrame(ROWS, DICTIONARY)
    names = spark.createDataFrame(list(enumerate(NAMES)), "nr int, name string")
    custom = spark.createDataFrame(CUSTOM, "word string, lemma string, pos string, parts array<string>")
    return M.Lexicon(dictionary, names, custom, spark.createDataFrame(RULES, "nr int, a string, b string, c string, d string, weight int"))


def answers(spark, words, lexicon):
    rows = M.lemmatize(spark.createDataFrame([(w,) for w in words], "word string"), lexicon).collect()
    return {r["word"]: (r["lemma"], r["pos"], r["root"], r["parts"], r["components"] and [c["lemma"] for c in r["components"]], r["strategy"]) for r in rows}


def test_cascade_against_recursion(spark, lexicon):
    worded = "dhammañca dhammañcā evañcā evancaca evanti santi santī hotīti jānāti jānātī gotamena sujātāya gotamaṃ aham ahamgacchāmī sattosmi sattomhī gacchāmī desetvā dese nolokadhamma nappahoti anagga aññāṇa nāloka adhammaloka alokadhamma lokadhamma lokodhammo lokadhammadhamma lokaagga paṭhamajhāna lokavaggo vagga buddhatheraapadāna theriapadānaṃ zzz yyyca nolokaxyz m tan only stub dhammā lokā labhāmā dhāmma lokadhāmma qq cacaca".split()
    pieces = [r[0] for r in ROWS] + ["ca", "pi", "na", "no", "a", "an", "ñcā", "osmi", "aham", "ti", "iti", "vaggo", "ā", "o", "gotam", "ena", "x", "ll"]
    draw = random.Random(5)
    words = worded + ["".join(draw.choices(pieces, k=draw.randint(1, 4))) for _ in range(1500)]
    got = answers(spark, [*words, *words[:50], None, ""], lexicon)
    assert set(got) == {*words, ""} and got[""][-1] == "unknown"
    wrong = {w: (got[w], plain(w)) for w in set(words) if got[w][:5] != (plain(w) or (None,) * 5)}
    assert not wrong, list(wrong.items())[:5]
    assert {a[-1] for a in got.values()} >= {"direct", "niggahita", "final_vowel", "pronoun", "nca", "particle", "name", "fused_pronoun", "verb_ending", "long_vowels", "known_compound", "title", "apadana", "causative", "negation", "compound", "custom", "english", "unknown"}


def test_odd_words(spark, lexicon):
    assert answers(spark, [], lexicon) == {}
    long_ = "ca" * 400
    assert answers(spark, [long_], lexicon)[long_][-1] == "unknown"
    alone = M.Lexicon(lexicon.dictionary)
    assert answers(spark, ["lokadhamma", "gotamena"], alone) == {w: (None, None, None, None, None, "unknown") for w in ("lokadhamma", "gotamena")}


def test_entries(spark):
    lookup = spark.createDataFrame([("a", "[2, 9, 1]", '["x + y"]'), ("b", None, ""), ("c", "[]", None)], "word string, headwords string, deconstructor string")
    heads = spark.createDataFrame([(1, "dhamma 1.01", "masc", ""), (2, "kar 3", "pr", "kar")], "id long, lemma_1 string, pos string, root_key string")
    rows = {r["word"]: r for r in M.entries(lookup, heads).collect()}
    first, missing, last = rows["a"]["headwords"]
    assert tuple(first) == ("kar", "pr", "√kar") and tuple(last) == ("dhamma", "masc", None) and missing is None
    assert rows["a"]["splits"] == ["x + y"] and not rows["b"]["headwords"] and not rows["c"]["headwords"]
