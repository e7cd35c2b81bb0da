"""Personal data by weak supervision, with DataFrame functions only.

Base spans (email, ip, card, phone) are found by fixed patterns, checked, and
always kept. Further candidates are keys, passwords and account numbers outside
base spans (one that meets a base span is left to it): tokens of eight or more
letters, digits and underscores with a digit among them, and, of any length,
what follows a gazetteer word (a quoted string, grouped digits or letters, or a
run without spaces) or an assignment (a run without spaces). Labelers vote on
each candidate:

- regex: shapes of keys, hex strings and checked account numbers (yes), words with a number behind them, plain words and short numbers (no);
- gazetteer: a word for a credential, an account, a bank or a document shortly before it (yes);
- context: an assignment right before it (yes), running words (no);
- mixture: the share of digits;
- extent: the length.

After a gazetteer word a value may be short or of letters only, so there the
votes against such shapes are withheld: all of them if the value is assigned,
those of regex, context and extent if it has a digit.

Votes of all candidates are counted by pattern (a few hundred rows at most).
Expectation-maximisation over these counts estimates each labeler's
reliability for both classes. It is anchored: a candidate that neither regex,
gazetteer nor context votes for is not personal, whatever the others say, and each
labeler has a prior of ``PRIOR`` votes that it is right more often than not. So a
corpus without personal data makes no class of it. The posteriors train the final span classifier, a logistic
regression over vote and shape features, which is applied as one SQL
expression. Candidates it accepts are added as kind ``secret``, or ``number``
where they have digits (and separators of groups) only; a token that meets an
accepted longer candidate is left to that one. Names of people and places are
not sought.

Candidates are found once and saved with the columns that the caller keeps.

Null texts count as empty; other columns stay as they are (one that has the
name of the output column is replaced). Repeated rows are treated alike. An empty table trains nothing
and adds no spans. Patterns are possessive, so long texts are read in linear
time and without deep recursion.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.store import saved

#: Base kinds in order.
KINDS = ("email", "ip", "card", "phone")
#: The same matches as the stated patterns. \G and the look-behind only skip starts that cannot be leftmost, possessive
#: repeats only positions that cannot matter.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[0-9](?:[\x20().-]*+[0-9])++|[\x20().-]++[0-9](?:[\x20().-]*+[0-9])*+)",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EXTRA = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{8,}+"
#: Gazetteer, fixed values: words (English, German, French, Spanish) for what follows them.
CREDENTIALS = (
    "password", "passwd", "passphrase", "passcode", "pin", "token", "secret", "apikey", "api_key", "api-key", "access_key", "private_key", "client_secret", "auth", "bearer", "credential", "key",
    "passwort", "kennwort", "geheimnis", "schlüssel", "zugangscode",
    "mot de passe", "clé", "jeton", "code secret", "code d'accès",
    "contraseña", "clave", "llave", "código de acceso",
)
ACCOUNTS = (
    "account", "account number", "iban", "bic", "swift", "routing number", "sort code", "bank", "card number", "customer number", "member id", "policy number",
    "konto", "kontonummer", "bankleitzahl", "kundennummer", "mitgliedsnummer", "versicherungsnummer",
    "compte", "numéro de compte", "banque", "numéro client",
    "cuenta", "número de cuenta", "banco", "número de cliente",
)
DOCUMENTS = (
    "ssn", "social security number", "passport", "passport number", "driving licence", "license number", "tax id", "national id", "patient id",
    "ausweis", "ausweisnummer", "reisepass", "führerschein", "steuernummer", "sozialversicherungsnummer",
    "passeport", "numéro de passeport", "numéro de sécurité sociale", "permis de conduire", "numéro fiscal",
    "pasaporte", "dni", "nie", "nif", "número de seguridad social", "licencia de conducir",
)
GAZETTEER = CREDENTIALS + ACCOUNTS + DOCUMENTS


def _alternation(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, the longest that fits: common beginnings are written once, so that a place in a text is tried once a letter."""
    if len(words) == 1:
        return re.escape(words[0])
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(h) + _alternation(tuple(rest)) for h, rest in sorted(heads.items())) + ("|" if "" in words else "") + ")"


_WORDS = _alternation(GAZETTEER)
_LINK = r"(?:\s(?:is|was|no\.?|nr\.?|number|ist|es|est))?+"
#: A run without spaces; marks at its end belong to the sentence.
_MARKS = r".,;:)\]}>\x22'\x60"
_RUN = rf"(?:[^\s\p{{Z}}{_MARKS}]++|[{_MARKS}]++(?=[^\s\p{{Z}}]))++"
_GROUPS = r"(?:[0-9]++(?:[\x20./-][0-9]++)++|[A-Z]{2}[0-9]{2}(?:[\x20-](?:[A-Z]{4}[\x20-])?+(?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4}+)++)" + rf"(?=[{_MARKS}]*+(?:[\s\p{{Z}}]|\z))"
_ASSIGN = r"(?:=|(?<![0-9]):)[=:]*+>?+"
#: What follows a gazetteer word (groups 1 and 2: before, value) or an assignment (3 and 4).
_FOLLOWS = (
    rf"(?iu)((?<![\p{{L}}\p{{N}}]){_WORDS}[\x22']?+{_LINK}(?:[\x20\t]{{0,4}}+{_ASSIGN}[\x20\t]{{0,4}}+|[\x20\t]{{1,4}}+)[\x22']?)"
    rf"((?<=\x22)[^\x22\r\n]++(?=\x22)|(?<=')[^'\r\n]++(?=')|{_GROUPS}|{_RUN})"
    rf"|({_ASSIGN}[\x20\t]{{0,4}}+[\x22']?+)(?![a-z]*+:?//)({_RUN})"
)
_A, _B = "\u0001", "\u0002"
_CONTEXT = 48


def _clean(text: Column) -> Column:
    """text without the two marker characters, same length."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(_A) | t.contains(_B), F.translate(t, _A + _B, "??")).otherwise(t)


def _matches(t: Column, pattern: str, possible: Column, marked: str = f"{_A}$0{_B}") -> Column:
    """array<struct<start, end, match, before>> of leftmost non-overlapping matches; code points, end exclusive."""
    parts = F.split(F.regexp_replace(t, F.lit(pattern), F.lit(marked)), _A, -1)
    item = "struct<start:bigint,end:bigint,match:string,before:string>"
    none = F.array().cast(f"array<{item}>")

    def step(s: Column, p: Column) -> Column:
        match = F.substring_index(p, _B, 1)
        found = F.struct(s["pos"].alias("start"), (s["pos"] + F.length(match)).alias("end"), match.alias("match"), s["before"].alias("before"))
        return F.struct(
            (s["pos"] + F.length(p) - 1).alias("pos"), F.right(p, F.lit(_CONTEXT)).alias("before"), F.array_append(s["out"], found.cast(item)).alias("out")
        )

    def spans(p: Column) -> Column:
        start = F.struct(F.length(p[0]).cast("long").alias("pos"), F.right(p[0], F.lit(_CONTEXT)).alias("before"), none.alias("out"))
        return F.aggregate(F.slice(p, F.lit(2), F.size(p)), start, step, lambda s: s["out"])

    # a one-element transform names the split once, so that it is not evaluated again for each use
    return F.when(possible, F.transform(F.array(parts), spans)[0]).otherwise(none)


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _iban(m: Column) -> Column:
    """Whether an account number of letters and digits passes its check: the remainder by 97 is 1."""
    plain = F.regexp_replace(m, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        value = F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (F.when(value > 9, rest * 100).otherwise(rest * 10) + value) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: _valid(kind, x["match"]))


def _numbered(nth: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(nth).alias("nth"), x["end"].alias("end")))


def of_kind(spans: Column, nth: int) -> Column:
    return F.filter(spans, lambda s: s["nth"] == nth)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are used afterwards."""
    one = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(one).alias("__one")).select(*keep, *[F.col(f"__one.{k}").alias(k) for k in columns])


def _with_matches(docs: DataFrame, text: str) -> DataFrame:
    """docs with __base (sorted struct<start, nth, end>) and __extra (candidates outside base spans)."""
    t = _clean(F.col(text))
    df = _once(docs, __digits=F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False)))
    possible = {"email": t.contains("@"), "ip": F.col("__digits"), "card": F.col("__digits"), "phone": F.col("__digits") & t.contains("+")}
    found = {f"__{k}": _checked(k, _matches(t, _PATTERNS[k], possible[k])) for k in KINDS}
    anchored = t.contains("=") | t.contains(":") | t.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){_WORDS}")
    df = _once(df, **found, __extra=_matches(t, _EXTRA, F.col("__digits")), __follows=_matches(t, _FOLLOWS, anchored, f"$1$3{_A}$2$4{_B}"))
    df = _once(df, __base=F.array_sort(F.concat(*[_numbered(n, F.col(f"__{k}")) for n, k in enumerate(KINDS)])))
    free = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    alone = lambda x: ~F.exists("__follows", lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))
    each = F.concat(F.transform("__follows", lambda x: x.withField("follows", F.lit(True))), F.transform(F.filter("__extra", alone), lambda x: x.withField("follows", F.lit(False))))
    return _once(df, __extra=F.filter(each, free)).drop("__digits", "__follows", *[f"__{k}" for k in KINDS])


#: Features of a candidate (match, before): votes are 1 (yes), 0 (no) or -1 (abstains); shapes are small numbers.
VOTES = ("regex", "gazetteer", "context", "mixture", "extent")
SHAPES = ("length", "upper", "letters")
#: Places in VOTES of the labelers of which one must vote for a candidate, and the votes' prior weight.
ANCHORS = (0, 1, 2)
PRIOR = 20.0
#: P(vote | class) before any data, for abstaining, no and yes, by class.
_BELIEF = {0: {-1: 0.4, 0: 0.45, 1: 0.15}, 1: {-1: 0.4, 0: 0.1, 1: 0.5}}


def _features(x: Column) -> dict[str, Column]:
    m, before = x["match"], F.lower(x["before"])
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    account = F.when(m.rlike("^[A-Z]{2}[0-9]{2}[\\x20A-Z0-9-]{11,40}$"), _iban(m)).otherwise(False)
    yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
    named = before.rlike(rf"(?:{_WORDS}[\"']?{_LINK}\W{{0,12}}|{_WORDS}\W{{0,4}})$")
    assigned = before.rlike(r"[=:]>?\s{0,4}[\"']?$")
    told, given = named & (assigned | (digits > 0)), named & assigned
    return {
        "regex": F.when(m.rlike("^(?:(?=.*[0-9])[0-9a-f]{16,}|(?=.*[0-9])[A-Z]{4}[A-Z0-9]{12,}|[0-9]{10,})$") | account, yes)
        .when(~told & m.rlike(r"^(?:\p{L}+[_-]?[0-9]{1,8}|\p{L}+|[0-9.,:/%-]{1,7}|[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}.*)$"), no)
        .otherwise(none),
        "gazetteer": F.when(named, yes).otherwise(none),
        "context": F.when(assigned & (named | (F.length(m) >= 8)), yes).when(~told & before.rlike(r"[a-z,] $"), no).otherwise(none),
        "mixture": F.when(digits * 5 >= F.length(m), yes).when(given, none).otherwise(no),
        "extent": F.when(F.length(m) >= 16, yes).when(~told & (F.length(m) < 12), no).otherwise(none),
        "length": F.least(F.expr("4"), F.floor(F.length(m) / 8)).cast("int"),
        "upper": m.rlike("[A-Z]").cast("int"),
        "letters": m.rlike("[A-Za-z]").cast("int"),
    }


def em(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], float, list[list[dict[int, float]]]]:
    """Posterior of 'personal' for each vote pattern, the class's share, and P(vote | class) of each labeler and class.

    Starts from the majority of the votes. A pattern without a vote by an anchor stays at 0.
    """
    sure = [any(votes[k] == 1 for k in ANCHORS) for votes, _ in counts]
    post = []
    for (votes, _), may in zip(counts, sure, strict=True):
        cast = [v for v in votes if v >= 0]
        post.append((sum(cast) + 0.5) / (len(cast) + 1) if may else 0.0)
    total = sum(n for _, n in counts)
    share, rates = 0.5, []
    for _ in range(rounds):
        weight = [sum(n * (p if c else 1 - p) for (_, n), p in zip(counts, post, strict=True)) for c in (0, 1)]
        share = (weight[1] + 1) / (total + 2)
        rates = []
        for k in range(len(VOTES)):
            of = []
            for c in (0, 1):
                seen = {v: PRIOR * _BELIEF[c][v] for v in (-1, 0, 1)}
                for (votes, n), p in zip(counts, post, strict=True):
                    seen[votes[k]] += n * (p if c else 1 - p)
                whole = sum(seen.values())
                of.append({v: x / whole for v, x in seen.items()})
            rates.append(of)
        post = []
        for (votes, _), may in zip(counts, sure, strict=True):
            odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if may else 0.0)
    return post, share, rates


def _inputs(row: dict[str, int]) -> list[float]:
    votes = [float(row[k] == v) for k in VOTES for v in (0, 1)]
    return [1.0, *votes, *[float(row["length"] == n) for n in range(5)], float(row["upper"]), float(row["letters"])]


def train(rows: list[dict[str, int]], steps: int = 300, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights of the logistic regression on EM's posteriors. rows: features and n; all weights 0 but a low bias without rows."""
    if not rows:
        return [-10.0, *[0.0] * (len(_inputs(dict.fromkeys([*VOTES, *SHAPES], 0))) - 1)]
    by_votes: dict[tuple[int, ...], int] = {}
    for r in rows:
        votes = tuple(r[k] for k in VOTES)
        by_votes[votes] = by_votes.get(votes, 0) + r["n"]
    patterns = sorted(by_votes.items())
    post = dict(zip([p for p, _ in patterns], em(patterns)[0], strict=True))
    data = [(_inputs(r), post[tuple(r[k] for k in VOTES)], r["n"]) for r in rows]
    total, w = sum(n for _, _, n in data), [0.0] * len(data[0][0])
    for _ in range(steps):
        slope = [decay * x for x in w]
        for x, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, v in enumerate(x):
                if v:
                    slope[i] += n * (p - y) / total
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


def _score(x: Column, w: list[float]) -> Column:
    f = _features(x)
    it = iter(w[1:])
    terms = [F.when(f[k] == v, next(it)).otherwise(0.0) for k in VOTES for v in (0, 1)]
    terms += [F.when(f["length"] == n, next(it)).otherwise(0.0) for n in range(5)]
    terms += [f["upper"] * next(it), f["letters"] * next(it)]
    return sum(terms, F.lit(w[0]))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", keep_text: bool = True) -> DataFrame:
    """docs with one more column: array<struct<start, nth, end, kind>> in order of start, then kind; base kinds have nth 0 to 3. Without ``keep_text`` the text column goes."""
    df = _with_matches(docs, text)
    df, _ = saved(df if keep_text else df.drop(text))
    each = df.filter(F.size("__extra") > 0).select(F.explode("__extra").alias("x"))
    counted = each.select(*[c.alias(k) for k, c in _features(F.col("x")).items()]).groupBy(*VOTES, *SHAPES).agg(F.count("*").alias("n"))
    weights = train(sorted((r.asDict() for r in counted.collect()), key=lambda r: sorted(r.items())))
    kind = F.create_map(*[x for n, k in enumerate((*KINDS, "secret", "number")) for x in (F.lit(n), F.lit(k))])
    # a candidate that no anchor votes for is never added
    voted = lambda x: reduce(Column.__or__, [_features(x)[VOTES[k]] == 1 for k in ANCHORS])
    df = _once(df, __extra=F.filter("__extra", lambda x: voted(x) & (_score(x, weights) >= 0)))
    whole = lambda x: x["follows"] | ~F.exists("__extra", lambda y: y["follows"] & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    more = F.transform(
        F.filter("__extra", whole),
        lambda x: F.struct(x["start"].alias("start"), F.when(x["match"].rlike(r"^[0-9]++(?:[\x20./-][0-9]++)*+$"), 5).otherwise(4).alias("nth"), x["end"].alias("end")),
    )
    spans = F.transform(F.array_sort(F.concat("__base", more)), lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["end"].alias("end"), kind[s["nth"]].alias("kind")))
    return _once(df, **{into: spans}).drop("__base", "__extra")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    df = find_pii(docs, text, "__pii")
    t = F.col(f"`{text}`")

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["pos"]
        gap = F.substring(t, (s["pos"] + 1).cast("int"), (x["start"] - s["pos"]).cast("int"))
        return F.struct(
            F.greatest(s["pos"], x["end"]).alias("pos"),
            F.when(fresh, F.concat(s["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(t, (s["pos"] + 1).cast("int"), F.length(t)))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    done = F.when(F.size("__pii") > 0, F.aggregate("__pii", start, step, rest)).otherwise(t)
    return df.withColumn(text, done).drop("__pii")
