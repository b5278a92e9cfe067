"""Problem 6: personal information inside free text.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their forms. Persons are found through the corpus: the list of
names is incomplete, so co-occurrence over all texts estimates how many bits each other term discloses about a person. With P(person) the share of
all words that stand in a full name made of listed parts, and P(person | term) the share of a term's occurrences that stand beside a known given or family
name, or an initial, in one of the forms of a full name, a term's information is log2(P(person | term) / P(person)), and what remains uncertain is
-log2 P(person | term). Terms with at least MIN_BITS of information and at most MAX_LEFT bits left join the list, in rounds until no
new one comes, as what they stand beside may be new as well. Full names made of listed and learned parts are then replaced, all details by typed
placeholders. `generalise` also replaces names that stand alone by [NAME]; it is off by default, as a lone name is to stay.

Defined results: null, empty and blank contents hold nothing; details are distinct per row and kind; where two overlap, e-mail comes
before identity number, phone, address and person, and a name inside another detail is no person; repeated rows each get their own; extra columns
are ignored. Scale: one pass over all texts gives details by form and counts, added up per task before any shuffle; texts with a family name, picked in
the JVM, are looked at again for persons. No text is shuffled; the list reaches the tasks as a broadcast while it is within MAX_TERMS, beyond that candidates
are joined with it; the result is the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, small_or_none, spread
from . import pii_rules as rules

MIN_BITS, MAX_LEFT = 1.0, 1.75
MAX_TERMS = 500_000
MAX_PICKED = 4_000
KINDS = ("email", "id_number", "phone", "address", "person")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
WORD_START = re.compile(r"[^\W\d_]+")
_SPACE = r"[  ]"
_MIDDLE = re.compile(rf"{_SPACE}(?:[^\W\d_]\.?{_SPACE}){{1,2}}\Z")
_AFTER = re.compile(rf"{_SPACE}[^\W\d_]\.")
_INITIALS = re.compile(rf"(?<![^\W_])(?:[^\W\d_]\.{_SPACE}?){{1,2}}\Z")
_COMMA_INITIAL = re.compile(rf",{_SPACE}[^\W\d_]\.(?:{_SPACE}?[^\W\d_]\.)?")


def _style(word: str) -> int:
    return 2 if word.isupper() and len(word) > 1 else 0 if word.islower() else 1


def fixed_details(text: str) -> list[tuple[int, int, str]]:
    """Everything but persons, in order, without overlaps."""
    mail = rules.emails(text)
    out = [(a, b, "email") for a, b in mail]

    def add(spans, kind):
        for a, b in spans:
            if not any(x < b and a < y for x, y, _ in out):
                out.append((a, b, kind))

    if any(c.isdigit() for c in text):
        ids = rules.id_numbers(text)
        add(ids, "id_number")
        add(rules.phones(text, ids), "phone")
        add(rules.addresses(text), "address")
    return sorted(out)


def name_pairs(text: str, words: list, blocked: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, given, family, commaless family first) of neighbouring words in a form of a full name; lower case terms."""
    free = [m for m in words if not any(a < m.end() and m.start() < b for a, b, _ in blocked)] if blocked else words
    for m, n in zip(free, free[1:]):
        gap = text[m.end() : n.start()]
        if not gap or len(gap) > 7:
            continue
        a, b = m.group().lower(), n.group().lower()
        if gap in (" ", " "):
            yield m.start(), n.end(), a, b, False
            yield m.start(), n.end(), b, a, True
        elif gap in (", ", ", "):
            tail = _AFTER.match(text, n.end())
            yield m.start(), tail.end() if tail else n.end(), b, a, False
    for i in range(len(free) - 2):
        m, n = free[i], free[i + 2]
        if len(free[i + 1].group()) == 1 and _MIDDLE.fullmatch(text[m.end() : n.start()]):
            yield m.start(), n.end(), m.group().lower(), n.group().lower(), False


def persons(text: str, words: list, blocked: list[tuple[int, int, str]], given, family) -> list[tuple[int, int]]:
    """Spans of full names whose parts are in the two lists."""
    out: list[tuple[int, int]] = []
    interesting = [i for i, m in enumerate(words) if m.group().lower() in family]
    if not interesting:
        return out
    near = sorted({j for i in interesting for j in range(i - 2, i + 3) if 0 <= j < len(words)})
    runs, run = [], [near[0]]
    for j in near[1:]:
        if j != run[-1] + 1:
            runs.append(run)
            run = []
        run.append(j)
    runs.append(run)
    found = []
    for run in runs:
        some = [words[j] for j in run]
        for begin, end, g, f, swapped in name_pairs(text, some, blocked):
            if g in given and f in family:
                found.append((swapped, -(end - begin), begin, end))
        for m in some:
            if m.group().lower() in family and not any(a < m.end() and m.start() < b for a, b, _ in blocked):
                first = _INITIALS.search(text, max(0, m.start() - 6), m.start()) if text[m.start() - 1 : m.start()] in (" ", " ") else None
                if first and (_style(m.group()) == 0 or first.group()[0].isupper()):
                    found.append((True, 0, first.start(), m.end()))
                last = _COMMA_INITIAL.match(text, m.end())
                if last:
                    found.append((True, 0, m.start(), last.end()))
    for _, _, begin, end in sorted(found):
        if not any(a < end and begin < b for a, b in out):
            out.append((begin, end))
    return out


def _notable(words: list, known) -> Iterator[list]:
    """Runs of neighbouring words that may be parts of a name: capitals, single letters, known words and the two beside them."""
    run, at = [], -2
    marked = set()
    for i, m in enumerate(words):
        w = m.group()
        if known is None or w.lower() in known:
            marked.update((i - 2, i - 1, i, i + 1, i + 2))
        elif not w[0].islower() or len(w) == 1:
            marked.add(i)
    for i in sorted(marked):
        if 0 <= i < len(words):
            if i != at + 1 and run:
                yield run
                run = []
            run.append(words[i])
            at = i
    if run:
        yield run


_PASS = "g string, f string, lower boolean, n bigint, seq bigint, kind string, value string, begin int, end int"


def _first_pass(messages: DataFrame, known) -> DataFrame:
    """Over all texts (seq, content): how often each term stands (g), and each pair (g, f) in a form of a full name, with whether it is written in lower case; and
    the details that have a form."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        listed = known.value
        seen: Counter = Counter()
        pairs: Counter = Counter()
        names = [x.split()[0] for x in _PASS.split(", ")]

        def flush():
            rows = [(t, None, False, n, None, None, None, None, None) for t, n in seen.items()] + [(*k, n, None, None, None, None, None) for k, n in pairs.items()]
            seen.clear()
            pairs.clear()
            return _typed(pd.DataFrame(rows, columns=names))

        for b in batches:
            found = []
            for seq, text in zip(b["seq"], b["content"]):
                blocked = fixed_details(text)
                found += [(None, None, None, None, seq, k, text[x:y], x, y) for x, y, k in blocked]
                words = list(WORD.finditer(text))
                if blocked:
                    words = [m for m in words if not any(x < m.end() and m.start() < y for x, y, _ in blocked)]
                seen.update(m.group().lower() for m in words)
                for run in _notable(words, listed):
                    for begin, end, g, f, swapped in name_pairs(text, run, ()):
                        if swapped or len(g) < 2 or len(f) < 2:
                            continue
                        value = text[begin:end]
                        lower = value.islower()
                        if lower:
                            if listed is not None and g not in listed and f not in listed:
                                continue
                        elif not value.isupper() and not (text[begin].isupper() and all(w[0].isupper() for w in WORD.findall(value))):
                            continue
                        pairs[g, f, lower] += 1
                for m in words:
                    f = m.group()
                    if not f.islower() and len(f) > 1:
                        beside = text[m.start() - 1 : m.start()] in (" ", "\u00a0") and _INITIALS.search(text, max(0, m.start() - 6), m.start())
                        if beside and beside.group()[0].isupper() or _COMMA_INITIAL.match(text, m.end()):
                            pairs["", f.lower(), False] += 1
            if found:
                yield _typed(pd.DataFrame(found, columns=names))
            if len(seen) + len(pairs) > 200_000:
                yield flush()
        yield flush()

    return cut(spread(messages.filter(F.length("content") > 0)).mapInPandas(count, _PASS))


def _typed(frame):
    return frame.astype({"lower": "boolean", "n": "Int64", "seq": "Int64", "begin": "Int32", "end": "Int32"})


def _listed(names: DataFrame) -> DataFrame:
    return names.filter("name is not null and name_part in ('given', 'family')").select(F.lower("name").alias("term"), F.col("name_part").alias("part")).distinct()


def learn_names(messages: DataFrame, names: DataFrame, min_bits: float = MIN_BITS, max_left: float = MAX_LEFT, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, part, bits, left): information of each term about a person and what remains uncertain; listed terms have no bits left, and bits null. part is
    given or family.

    Pairs are neighbouring words of one letter case in a form of a full name; pairs in lower case count where one of the two is
    listed. Terms and pairs are counted over all texts."""
    return _learn(messages.select(F.lit(None).cast("bigint").alias("seq"), "content"), names, min_bits, max_left, max_terms)[0]


def _learn(messages: DataFrame, names: DataFrame, min_bits: float, max_left: float, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """The list, and the first pass."""
    spark = messages.sparkSession
    listed = _listed(names)
    few = small_or_none(listed.select("term").distinct(), max_terms)
    known = spark.sparkContext.broadcast({r[0] for r in few} if few is not None else None)  # at most max_terms words
    first = _first_pass(messages, known)
    counted = cut(first.filter("kind is null").groupBy("g", "f", "lower").agg(F.sum("n").alias("n")))
    terms = counted.filter("f is null").select(F.col("g").alias("term"), F.col("n").alias("c"))
    pairs = counted.filter("f is not null")
    if few is None:  # the list is too long for the tasks to look into
        words = listed.select("term").distinct()
        for side in ("g", "f"):
            pairs = pairs.join(words.select(F.col("term").alias(side), F.lit(True).alias(f"listed_{side}")), side, "left")
        pairs = cut(pairs.filter("not lower or listed_g or listed_f").select("g", "f", "n"))
    part = lambda p, c: listed.filter(F.col("part") == p).select(F.col("term").alias(c))
    sure = pairs.join(part("given", "g"), "g", "left_semi").join(part("family", "f"), "f", "left_semi").agg(F.sum("n")).first()[0] or 0
    total = terms.agg(F.sum("c")).first()[0] or 1
    person = max(2 * sure, 1) / total
    lexicon = cut(listed.select("term", "part", F.lit(None).cast("double").alias("bits"), F.lit(0.0).alias("left")))
    while True:
        found = None
        for part_, other, mine, beside in (("family", "given", "f", "g"), ("given", "family", "g", "f")):
            anchors = lexicon.filter(F.col("part") == other).select(F.col("term").alias(beside)).union(spark.createDataFrame([("",)], "t string"))  # "" stands for an initial
            hits = pairs.join(anchors, beside, "left_semi").groupBy(F.col(mine).alias("term")).agg(F.sum("n").alias("j")).filter("term <> ''")
            share = F.least(F.lit(1.0), F.col("j") / F.col("c"))
            scored = hits.join(terms, "term").select("term", F.lit(part_).alias("part"), F.log2(share / person).alias("bits"), (-F.log2(share)).alias("left"))
            scored = scored.filter((F.col("bits") >= min_bits) & (F.col("left") <= max_left))
            found = scored if found is None else found.unionByName(scored)
        new = cut(found.join(lexicon.select("term", "part"), ["term", "part"], "left_anti"))
        if new.isEmpty():
            return lexicon, first
        lexicon = cut(lexicon.unionByName(new))


_DETAIL = "seq bigint, kind string, value string, begin int, end int"


def _lone(words: list, taken: list[tuple], given, family) -> list[tuple[int, int]]:
    """Names that stand alone, not written in lower case."""
    parts = (m for m in words if not m.group().islower() and (m.group().lower() in family or m.group().lower() in given))
    return [m.span() for m in parts if not any(t[0] < m.end() and m.start() < t[1] for t in taken)]


def find_details(messages: DataFrame, names: DataFrame, min_bits: float = MIN_BITS, max_left: float = MAX_LEFT, max_terms: int = MAX_TERMS, generalise: bool = False) -> DataFrame:
    """(seq, kind, value, begin, end) of every detail in content (seq, content), by position in code points; with generalise also of kind name."""
    texts = messages.select("seq", "content").filter(F.length("content") > 0)
    lexicon, first = _learn(texts, names, min_bits, max_left, max_terms)
    formed = first.filter("kind is not null").select("seq", "kind", "value", "begin", "end")
    rows = small_or_none(lexicon.select("term", "part"), max_terms)
    if rows is None:
        return formed.unionByName(_persons_by_join(texts, lexicon, generalise))
    given, family = (frozenset(r[0] for r in rows if r[1] == p) for p in ("given", "family"))
    shared = messages.sparkSession.sparkContext.broadcast((given, family))
    picked = sorted({WORD_START.search(w).group() for w in (family | given if generalise else family) if WORD_START.search(w)})
    if len(picked) <= MAX_PICKED:  # a term's first letters stand in each text that holds the term
        texts = texts.filter(F.arrays_overlap(F.split(F.lower("content"), r"[^\p{L}]+"), F.array(*[F.lit(w) for w in picked]).cast("array<string>")))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([x for seq, text in zip(b["seq"], b["content"]) for x in _named(seq, text, *shared.value, generalise)], columns=["seq", "kind", "value", "begin", "end"])

    return formed.unionByName(spread(texts).mapInPandas(run, _DETAIL))


def _named(seq: int, text: str, given, family, generalise: bool) -> list[tuple]:
    words, blocked = list(WORD.finditer(text)), fixed_details(text)
    full = persons(text, words, blocked, given, family)
    out = [(seq, "person", text[x:y], x, y) for x, y in full]
    return out + [(seq, "name", text[x:y], x, y) for x, y in _lone(words, [*blocked, *full], given, family)] if generalise else out


def _persons_by_join(texts: DataFrame, lexicon: DataFrame, generalise: bool) -> DataFrame:
    """The same persons where the list is too long to broadcast: each text with the listed ones of its own words."""

    def words(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            pairs = [(s, w) for s, t in zip(b["seq"], b["content"]) for w in {m.group().lower() for m in WORD.finditer(t)}]
            yield pd.DataFrame(pairs, columns=["seq", "term"])

    own = texts.mapInPandas(words, "seq bigint, term string").join(lexicon, "term").groupBy("seq").agg(F.collect_set(F.when(F.col("part") == "given", F.col("term"))).alias("given"), F.collect_set(F.when(F.col("part") == "family", F.col("term"))).alias("family"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for seq, text, given, family in zip(b["seq"], b["content"], b["given"], b["family"]):
                out += _named(seq, text, set(given), set(family), generalise)
            yield pd.DataFrame(out, columns=["seq", "kind", "value", "begin", "end"])

    return texts.join(own, "seq").mapInPandas(run, _DETAIL)


def redact(messages: DataFrame, names: DataFrame, generalise: bool = False) -> DataFrame:
    """(seq, content) with details replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [PERSON], with generalise lone names by [NAME]; other texts stay as
    they are."""
    found = find_details(messages, names, generalise=generalise).groupBy("seq").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "kind"))).alias("d"))  # as many as one text holds
    rows = messages.select("seq", "content").join(found, "seq", "left")
    piece = F.aggregate("d", F.struct(F.lit("").alias("t"), F.lit(0).alias("p")), lambda acc, x: F.struct(F.concat(acc["t"], F.substring(F.col("content"), acc["p"] + 1, x["begin"] - acc["p"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("t"), x["end"].alias("p")))
    rows = rows.withColumn("r", piece)
    return rows.select("seq", F.when(F.col("d").isNull(), F.col("content")).otherwise(F.concat(F.col("r.t"), F.substring(F.col("content"), F.col("r.p") + 1, F.length("content")))).alias("content"))
