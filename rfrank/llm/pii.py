"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds are exact: a pattern, and a test that a match must pass. Beyond them there are candidates
of five more kinds:

* ``secret``: what follows a field word such as ``password``, whatever its characters and length, and every
  token of letters and digits with a digit in it;
* ``id``: numbers in groups, and account numbers that begin with a country's letters;
* ``name``: two to four capitalised words, or what follows a title or a word that asks for a name;
* ``address``: a house number with a street, in the forms of four languages;
* ``birth``: a date in figures.

A regex, a gazetteer, a context and a shape labeller vote on each candidate; expectation-maximisation over
the counts of vote patterns estimates their reliabilities for each kind, and the posteriors train the final
span classifier, a log-odds model over hashed features, which decides what is added.

One scan finds base spans and candidates; neither the texts nor anything else is shuffled but the counts
of vote patterns and of feature buckets, both of bounded number and combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that Java's engine neither backtracks nor recurses: runs are possessive,
#: and a match starts where a run starts, or where the match before ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character, or without a digit, has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Words that name what follows them.
PRIVATE_FIELDS = (
    "password", "passwd", "pwd", "passwort", "token", "secret", "key", "apikey", "api_key", "access_key", "auth",
    "login", "pin", "ssn", "iban", "passport", "account", "konto", "contraseña", "clave", "user", "username", "passphrase",
    "credential", "credentials", "bearer", "licence", "mot de passe", "kennwort", "apitoken", "private_key", "client_secret",
)
PUBLIC_FIELDS = (
    "page", "seite", "pagina", "página", "chapter", "kapitel", "chapitre", "volume", "vol", "figure", "fig", "table",
    "version", "v", "section", "article", "artikel", "year", "jahr", "año", "build", "model", "no",
)
FIRST_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Mary", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Emma", "Maria",
    "Thomas", "Peter", "Hans", "Klaus", "Jürgen", "Stefan", "Andreas", "Ursula", "Petra", "Sabine", "Jean", "Pierre", "Michel", "Marie", "Nathalie",
    "Isabelle", "Sophie", "José", "Juan", "Carlos", "Antonio", "Manuel", "Carmen", "Ana", "Laura", "Alice", "Bob", "Daniel", "Paul", "Jane", "Kevin",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra")
ASKING = ("name", "nombre", "nom", "holder", "contact", "patient", "signed", "inhaber", "dear", "called", "named", "hello", "hi", "liebe", "lieber", "cher", "chère", "estimado", "estimada", "querido", "querida", "llamo", "heiße", "appelle", "heisst", "llama")
#: Words that begin a letter or stand before a name and are themselves written large.
GREETINGS = ("Dear", "Hello", "Hi", "Contact", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Querido", "Querida", "Patient", "Signed", "Name")
#: Words of institutions, works and places that stand in capitals like a name.
NO_NAMES = (
    "General", "Public", "License", "Licence", "University", "Institute", "Department", "Ministry", "Committee", "Company", "Corporation", "Foundation", "Association", "Society",
    "Museum", "Library", "School", "College", "Church", "Street", "Road", "Avenue", "River", "Lake", "Mount", "Island", "Ocean", "Sea", "City", "County", "State", "States", "United",
    "National", "International", "Central", "North", "South", "East", "West", "New", "Old", "Great", "Saint", "World", "War", "Party", "Act", "Bill", "Law", "Rights", "Reserved", "Terms",
    "Privacy", "Policy", "Copyright", "Creative", "Commons", "Open", "Source", "Software", "Free", "The", "This", "That", "These", "Chapter", "Section", "Figure", "Table", "Volume",
    "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
BIRTH = ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Way", "Court", "Place", "Square")

ADDED = ("secret", "id", "name", "address", "birth")
_WORD = r"[\p{L}0-9_]"
_SURNAME = r"\p{Lu}\p{Ll}++"
#: Pattern by kind. Where a group is named, it is the candidate and ends the match; what is before it is context.
CANDIDATES = (
    ("id", r"(?<![A-Za-z0-9])(?<![0-9]{4}-)(?![0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))(?:[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}+(?:[\x20-]?[A-Z0-9]{1,3})?+|[0-9]{2,}+(?:[\x20-][0-9]{2,}+)++)(?![A-Za-z0-9])"),
    ("birth", r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9./-])"),
    ("address", rf"(?=[0-9\p{{Lu}}rbcap])(?<!{_WORD})(?:[0-9]{{1,5}}[A-Za-z]?\x20(?:{_SURNAME}\x20){{1,3}}(?:{'|'.join(STREETS)})(?!{_WORD})|\p{{Lu}}\p{{L}}*?(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?(?!{_WORD})|(?:[0-9]{{1,4}},?\x20)?(?:rue|boulevard|chemin|calle|avenida|plaza)(?:\x20(?:des?|du|la|le|del)(?=\x20))*+\x20{_SURNAME}(?:,?\x20[0-9]{{1,4}}(?!{_WORD}))?)"),
    ("secret", rf"(?i)(?<!{_WORD})(?:{'|'.join(PRIVATE_FIELDS)})(?!{_WORD})[\"']?\s{{0,3}}+(?:[:=]|(?:is|ist|est|es)(?!{_WORD}))\s{{0,3}}+[\"']?([^\s\"'<>,;=:]++)"),
    ("name", rf"(?<!{_WORD})(?:(?:{'|'.join(GREETINGS)})\x20)?+(?:(?:{'|'.join(TITLES)})\.?+\x20)?+({_SURNAME}(?:[\x20-]{_SURNAME}){{1,3}}+)"),
    ("secret", r"(?<![A-Za-z0-9])(?:[A-Za-z]*+[0-9][A-Za-z0-9]*+|A[KS]IA[A-Z]{12,}+)"),
)
BUCKETS = 1024
#: Candidates that a bucket's usual share counts for.
PRIOR = 5.0
#: Code points of a candidate's surroundings that labellers and features see.
LEFT, RIGHT = 24, 12
ABSTAIN, CLEAN, PRIVATE = 0, 1, 2
#: Of a labeller's votes on clean candidates, at most this share is for private; on private ones, at least that.
MOST_FALSE, LEAST_TRUE = 0.15, 0.6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        double = (F.length(digits) - i) % 2 == 1
        return total + F.when(double, x * 2 - F.when(x >= 5, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a match is personal data of its kind."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, inner: bool = False) -> Column:
    """All matches as (start, end, value, left, right): code points, end exclusive, and the text around.

    With ``inner`` the pattern's first group, which ends the match, is the value; marks that end a sentence or a
    bracket after it are left off.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if inner else found
    split = F.struct(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("gaps"))

    def span(x: Column) -> Column:
        value = F.regexp_replace(x["v"], r"[.!?)\]}]++$", "") if inner else x["v"]
        start = x["end"] - F.length(x["v"])
        before = F.concat(F.substring(x["gap"], -LEFT, LEFT), F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(x["v"]))) if inner else x["gap"]
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.substring(before, -LEFT, LEFT).alias("left"), F.substring(x["next"], 1, RIGHT).alias("right"))

    def spans(w: Column) -> Column:
        n = F.size(w["m"])
        gaps, after = F.slice(w["gaps"], F.lit(1), n), F.slice(w["gaps"], F.lit(2), n)
        ends = _running(F.zip_with(w["m"], gaps, lambda m, g: F.length(m) + F.length(g)))
        return F.transform(F.arrays_zip(w["m"].alias("m"), w["v"].alias("v"), gaps.alias("gap"), after.alias("next"), ends.alias("end")), span)

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return _let(split, lambda w: F.when(F.size(w["m"]) > 0, spans(w)).otherwise(none))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: Spark computes what a lambda refers to for every element anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column, block: int = 128) -> Column:
    """Running sums of a list that is not empty, by blocks: a sum that is carried as a list is copied at every step."""

    def sums(items: Column, size) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(items, start, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + size(x))).alias("ends")))

    def of(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        blocks = F.transform(numbers, lambda i: sums(F.slice(s, i * block + 1, F.lit(block)), lambda x: x))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, sums(b, lambda x: x["at"])["ends"], lambda x, end: F.transform(x["ends"], lambda e: e + end - x["at"]))))

    return _let(sizes, of)


def _field(left: Column) -> Column:
    """The word that what follows ``left`` belongs to, if only blanks, marks and a verb lie between."""
    return F.regexp_extract(left, r"([\p{L}_]+)(?:[\s=:\"'.]*(?:(?:is|ist|est|es)\s)?[\s=:\"']*)$", 1)


def _votes(kind: str, c: Column) -> dict[str, Column]:
    """The labellers' votes on a candidate (value, left, right) of a kind."""
    value, near, left = c["value"], c["left"], F.lower(c["left"])
    field = _field(left)
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    digits = F.length(_digits(value))
    named = F.when(field.isin(*PRIVATE_FIELDS), PRIVATE).when(field.isin(*PUBLIC_FIELDS), CLEAN)
    assigned = F.when(left.rlike(r"[=:]\s*[\"']?$"), PRIVATE)
    told = field.isin(*PRIVATE_FIELDS) & left.rlike(r"(?:[=:]|\b(?:is|ist|est|es))\s*[\"']?$")  # then shortness or plainness says nothing
    if kind == "secret":
        known = r"^(?:AKIA|ASIA)[A-Z0-9]{12,}$|^(?=[0-9]*[a-f])[0-9a-f]{16,}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^(?:sk|pk|ghp|gho|xox[bp])[-_][-_A-Za-z0-9]{8,}$|^eyJ[-_A-Za-z0-9.]{16,}$"
        plain = r"^[0-9]{1,8}$|^[0-9]+(?:st|nd|rd|th|px|pt|em|km|kg|mm|cm|kb|mb|gb|k|m)$|^\p{L}+$"
        return {
            "regex": F.when(value.rlike(known), PRIVATE).when(value.rlike(plain) & ~told, CLEAN),
            "gazetteer": named,
            "context": assigned.when(left.rlike(r"[\p{L},;.]\s+$") & ~mixed, CLEAN),
            "shape": F.when((mixed & (F.length(value) >= 16)) | value.rlike(r"^(?=.*[^\p{L}0-9])(?=.*[0-9])(?=.*\p{L}).{6,}$"), PRIVATE).when((F.length(value) < 9) & ~told, CLEAN),
        }
    if kind == "id":
        return {
            "regex": F.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]{4}"), PRIVATE).when(value.rlike(r"^(?:1[0-9]|20)[0-9]{2}[\x20-](?:[0-9]{2}|(?:1[0-9]|20)[0-9]{2})$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), CLEAN),
            "gazetteer": named,
            "context": assigned.when(left.rlike(r"[\p{L},;.)]\s+$"), CLEAN),
            "shape": F.when(digits >= 9, PRIVATE).when(digits < 8, CLEAN),
        }
    if kind == "name":
        titled = near.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(TITLES)})\.?\s$")
        return {
            "regex": F.when(titled, PRIVATE),
            "gazetteer": F.when(F.arrays_overlap(F.split(value, r"[\x20-]"), F.array(*map(F.lit, NO_NAMES))), CLEAN).when(F.regexp_extract(value, r"^\p{L}+", 0).isin(*FIRST_NAMES), PRIVATE),
            "context": F.when(field.isin(*ASKING) | left.rlike(r"(?:signed|written|sent|approved|prepared) by\s$"), PRIVATE).when(~titled & left.rlike(r"(?:^|[.!?\n]\s*)$"), CLEAN),
            "shape": F.when(value.rlike(r"^\p{L}{2,12}(?:[\x20-]\p{L}{2,14}){1,2}$"), ABSTAIN).otherwise(CLEAN),
        }
    if kind == "address":
        return {
            "regex": F.when(value.rlike("[0-9]"), PRIVATE).otherwise(CLEAN),
            "gazetteer": F.when(value.rlike(rf"(?:{'|'.join(STREETS)})$|(?i)straße|strasse|^[0-9]+,? rue|calle"), PRIVATE),
            "context": F.when(left.rlike(r"(?:address|adresse|dirección|anschrift|lives? at|lived at|living at|wohnt|wohnhaft|habite|vive en)[^\p{L}]*(?:in der|à|au|en|at)?\s*$"), PRIVATE),
            "shape": F.when(c["right"].rlike(r"^,?\s[0-9]{4,5}|^,\s\p{Lu}"), PRIVATE),
        }
    parts = F.split(value, "[./-]")
    year = F.greatest(*[F.get(parts, F.lit(i)).try_cast("int") for i in (0, 2)])
    word = rf"(?<!\p{{L}})(?:{'|'.join(BIRTH)})(?!\p{{L}})"
    born = left.rlike(word) | F.lower(c["right"]).rlike(rf"^\s{word}")
    return {
        "regex": F.when(F.get(parts, F.lit(1)).try_cast("int").between(1, 31), ABSTAIN).otherwise(CLEAN),
        "gazetteer": F.when(field.isin(*BIRTH), PRIVATE),
        "context": F.when(born, PRIVATE).otherwise(CLEAN),
        "shape": F.when(~year.between(0, 99) & ~year.between(1850, 2100), CLEAN),
    }


LABELLERS = ("regex", "gazetteer", "context", "shape")


def _features(kind: str, c: Column) -> Column:
    """Hashed features of a candidate of a kind: its letter pattern, length, neighbours, field word, and what labellers look for."""
    value, left = c["value"], F.lower(c["left"])
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")
    made = [
        F.concat(F.lit("s"), F.substring(shape, 1, 4)),
        F.concat(F.lit("n"), F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("t"), F.least(F.length(shape), F.lit(12)).cast("string")),
        F.concat(F.lit("l"), F.substring(left, -1, 1)),
        F.concat(F.lit("r"), F.substring(c["right"], 1, 1)),
        F.concat(F.lit("f"), _field(left)),
    ]
    if kind in ("name", "birth"):
        votes = _votes(kind, c)
        made += [F.concat(F.lit(k), F.coalesce(votes[k], F.lit(ABSTAIN)).cast("string")) for k in ("regex", "gazetteer", "context")]
    return F.array(*[F.pmod(F.xxhash64(F.lit(kind), m), F.lit(BUCKETS)).cast("int") for m in made])


def fit_reliabilities(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], list[tuple[float, float]], float]:
    """EM over counts of vote patterns (base 3, first labeller most significant).

    Returns each pattern's posterior of being private, each labeller's share of private votes among its
    votes on (clean, private) candidates, and the share of private candidates. Not voting says nothing.
    """
    m = len(LABELLERS)
    votes = {p: [p // 3 ** (m - 1 - k) % 3 for k in range(m)] for p in patterns}
    rate, share = [(0.1, 0.8)] * m, 0.2
    post: dict[int, float] = {}
    for _ in range(rounds):
        for p, v in votes.items():
            odds = math.log(share / (1 - share))
            for (c, q), x in zip(rate, v, strict=True):
                odds += math.log(q / c) if x == PRIVATE else math.log((1 - q) / (1 - c)) if x == CLEAN else 0
            post[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        total = sum(patterns.values())
        share = min(0.95, max(0.001, (sum(n * post[p] for p, n in patterns.items()) + 1) / (total + 5)))
        new = []
        for k in range(m):
            # Pseudo-votes keep a labeller better than chance, and bounds one that only ever votes one way.
            counts = [[1.0, 9.0], [8.0, 2.0]]
            for p, n in patterns.items():
                if votes[p][k]:
                    counts[0][votes[p][k] == CLEAN] += n * (1 - post[p])
                    counts[1][votes[p][k] == CLEAN] += n * post[p]
            new.append((min(MOST_FALSE, counts[0][0] / sum(counts[0])), max(LEAST_TRUE, counts[1][0] / sum(counts[1]))))
        done = max(abs(a - b) for x, y in zip(rate, new, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9
        rate = [(min(max(c, 1e-4), 0.9999), min(max(q, 1e-4), 0.9999)) for c, q in new]
        if done:
            break
    return post, rate, share


def find_pii(docs: DataFrame, carry: Sequence[Column | str] = ("*",), text_col: str = "text") -> DataFrame:
    """Find spans of personal data in every text.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``base`` and ``spans``,
    arrays of (start, kind_no, kind, end) in order of start, then kind; ``spans`` holds the base spans
    and those that the classifier adds, of the kinds in ``ADDED``. Positions are code points, ends exclusive.

    A null text counts as empty and has no spans; repeated rows are treated alike; an empty table, or one
    without candidates, adds nothing; a text of any length is searched whole. What is added depends on ``LEFT`` code points
    before a candidate and ``RIGHT`` after it; dates of birth have a year of two figures or one from 1850 to 2100. Spans of different base kinds may overlap; an added span overlaps no
    base span, and none of a kind before its own. Other columns ride along inside ``row``, whatever their names.
    """
    text = F.col("text")
    scan = docs.select(F.struct(*carry).alias("row"), text_of(text_col).alias("text"))
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")

    def base(no: int, kind: str) -> Column:
        there = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else digit
        if kind in ("ip", "phone"):
            there = there & digit
        spans = F.filter(_placed(text, PATTERNS[kind]), lambda s: passes(kind, s["value"]))
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end")))
        return F.when(there, spans).otherwise(none)

    empty = F.array().cast("array<struct<start:int,end:int,kind_no:int,votes:int,features:array<int>>>")
    lowered = F.lower(text)

    def candidates(kind: str, pattern: str) -> Column:
        inner = "(" in pattern and kind == "name" or pattern.startswith("(?i)")
        judged = F.transform(
            _placed(text, pattern, inner),
            lambda c: F.struct(
                c["start"].alias("start"),
                c["end"].alias("end"),
                F.lit(ADDED.index(kind)).alias("kind_no"),
                sum((F.coalesce(v, F.lit(ABSTAIN)) * 3 ** (len(LABELLERS) - 1 - LABELLERS.index(k)) for k, v in _votes(kind, c).items()), F.lit(0)).alias("votes"),
                _features(kind, c).alias("features"),
            ),
        )
        judged = F.filter(judged, lambda c: c["start"] < c["end"])
        # Most texts have no match; a plain test that a match implies spares them the pattern's passes.
        if kind == "name":
            there = text.rlike(r"\p{Lu}\p{Ll}++[\x20-]\p{Lu}\p{Ll}")
        elif inner:
            there = reduce(or_, (F.contains(lowered, F.lit(w)) for w in _roots(PRIVATE_FIELDS)))
        else:
            there = digit | (F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA")) if kind == "secret" else F.lit(False))
        return F.when(there, F.when(text.rlike(pattern), judged)).otherwise(empty)

    def apart(c: Column, others: Column) -> Column:
        return ~F.exists(others, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    found = scan.select("row", F.array_sort(F.concat(*[base(i, k) for i, k in enumerate(KINDS)])).alias("base"), *[candidates(*c).alias(f"c{i}") for i, c in enumerate(CANDIDATES)])
    # A candidate lies apart from base spans and from candidates of the patterns before.
    def joined(before: Column, more: str) -> Column:
        return F.concat(before, F.filter(F.coalesce(more, empty), lambda c: apart(c, F.col("base")) & apart(c, before)))

    free = empty
    for i in range(len(CANDIDATES)):
        found = found.withColumn(f"free{i}", joined(free, f"c{i}"))
        free = F.col(f"free{i}")
    found = materialize(found.select("row", "base", free.alias("candidates")), "pii")

    votes = found.select(F.explode("candidates").alias("c")).select("c.kind_no", "c.votes", "c.features")
    patterns: dict[int, dict[int, int]] = {}
    for r in votes.groupBy("kind_no", "votes").count().collect():
        patterns.setdefault(r["kind_no"], {})[r["votes"]] = r["count"]
    if not patterns:
        return found.select("row", "base", F.col("base").alias("spans"))
    posterior = {kind: fit_reliabilities(counts)[0] for kind, counts in patterns.items()}

    # The classifier: log odds of each feature bucket by posterior weight, at most BUCKETS of them for each kind.
    n_votes = 3 ** len(LABELLERS)
    told = {kind * n_votes + v: q for kind, of in posterior.items() for v, q in of.items()}
    weight = F.get(_numbers([told.get(i, 0.0) for i in range(len(ADDED) * n_votes)]), F.col("kind_no") * n_votes + F.col("votes"))
    sums = (
        votes.select("kind_no", weight.alias("q"), F.explode("features").alias("bucket"))
        .groupBy("kind_no", "bucket")
        .agg(F.sum("q").alias("private"), F.sum(1 - F.col("q")).alias("clean"))
        .collect()
    )
    private = {kind: sum(n * posterior[kind][v] for v, n in of.items()) for kind, of in patterns.items()}
    clean = {kind: sum(of.values()) - private[kind] for kind, of in patterns.items()}
    # Shares are drawn towards the bucket's share among all of the kind's candidates: one seen seldom says little.
    weights = [0.0] * (BUCKETS * len(ADDED))
    for r in sums:
        k = r["kind_no"]
        usual = PRIOR * (r["private"] + r["clean"]) / (private[k] + clean[k])
        weights[k * BUCKETS + r["bucket"]] = math.log((r["private"] + usual) / (private[k] + PRIOR)) - math.log((r["clean"] + usual) / (clean[k] + PRIOR))
    bias = _numbers([math.log((private.get(k, 0) + 0.5) / (clean.get(k, 0) + 0.5)) for k in range(len(ADDED))])
    table = _numbers(weights)

    def added(c: Column) -> Column:
        return F.aggregate(c["features"], F.get(bias, c["kind_no"]), lambda total, b: total + F.get(table, c["kind_no"] * BUCKETS + b)) > 0

    kinds = F.array(*map(F.lit, ADDED))
    more = F.transform(
        F.filter("candidates", added),
        lambda c: F.struct(c["start"].alias("start"), (c["kind_no"] + len(KINDS)).alias("kind_no"), F.get(kinds, c["kind_no"]).alias("kind"), c["end"].alias("end")),
    )
    return found.select("row", "base", F.when(F.size("candidates") > 0, F.array_sort(F.concat(F.col("base"), more))).otherwise(F.col("base")).alias("spans"))


def _roots(words: Sequence[str]) -> list[str]:
    """The words in which no other one is found."""
    return [w for w in words if not any(v != w and v in w for v in words)]


def _numbers(values: Sequence[float]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in the whole of ``documents``; after the contract's columns ``n_spans``, how many spans there are of any kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs, carry=["doc_id"]).select(
        "row.doc_id",
        *map(count, KINDS),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
