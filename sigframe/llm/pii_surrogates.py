"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Found are e-mail addresses, phone numbers, payment cards (of a known issuer, with a valid check digit), IBANs (with valid check digits), IP addresses of both versions, US social
security numbers, access keys and other secrets with a known prefix, 40-digit hex tokens, passwords after ``password=`` or ``password:``, and names after a form of
address. A name met so is looked for in the rest of that text too, without a form of address and in part; a capitalised word right before it is its first name,
unless it is one that opens sentences.

Every pattern repeats possessively or a bounded number of times, so texts of any length are searched without backtracking and without a deep stack. Long runs of
digits are cut into rows of whole groups first; a group is looked at together with the next five at most, and a run costs work in proportion to its length.

An entity is a normal form (lower case, digits alone): of an address its local part and its domain, of a name each word. It gets one surrogate in the
whole corpus, so whoever is named in full, by last name, or with another title stays one, and addresses of one domain share theirs. A surrogate
is made character by character from a keyed SHA-512: digits become digits and letters letters of the same script, separators, length, country
code, issuer digits and domain ending stay, check digits are valid and octets stay below 255. Words of names are syllables of their script; a first name has the
ending of the gender that its forms of address mostly say in the corpus. A mention takes the surrogate in its own separators and case, so mentions that agree still agree.

Collisions are checked over all entities: no two of a type share a surrogate, and none is an entity that occurs itself. Losers try again with the next
number; what is left after ``ROUNDS`` gets a tag of its own. Texts without entities pass as they are. Null and empty texts stay
so. Repeated rows get the same text. An empty table gives no rows. All other columns stay; their names may be any but ``_pii_...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

KEY = "sigframe-surrogates-1"
ROUNDS = 12
_WORD = r"\p{L}\p{N}"
#: Forms of address, by gender.
MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "Госпожа"]
NEUTRAL = ["Dr", "Prof"]
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d\-])"
_IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_TOKEN = r"(?:[0-9a-f]{40}|[0-9A-F]{40})(?![A-Za-z0-9])"
_HEX = "[0-9a-fA-F]{1,4}"
#: Not a part of a longer run of digits.
_ALONE, _ENDS = r"(?<![\p{L}\d.,/\-])(?<!\d )", r"(?![\p{L}\d/]|[.,\-]\d| \d)"
#: A capital and at least one more letter.
_NAME = r"\p{Lu}(?:\p{L}|['’](?=\p{Lu}))++"
_INITIALS = r"(?:\p{Lu}\. ?){0,2}"
#: The first digits of the issuers' ranges of card numbers.
ISSUERS = r"^(?:4|5[0-8]|6|3[04-9]|2(?:20[0-5]|22[1-9]|2[3-9]|[3-6]\d|7[01]|720))"
#: What secrets of well-known services begin with.
SECRETS = r"(?:(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|xox[abprs]-|AIza)"
#: Sizes of the groups that cards are written in, besides one group.
GROUPINGS = ["4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3"]
#: What each type looks like. Of a card, that is a run of digits which may have other numbers before and after it.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+\-])[{_WORD}._%+\-]++@[{_WORD}\-]++(?:\.[{_WORD}\-]++)++",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)"
    rf"|{_ALONE}(?:\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|0\d{{2,4}}[ /\-]\d{{5,8}}|0[1-9](?: \d\d){{4}}){_ENDS}",
    "ssn": rf"(?<![\d\-]){_SSN}",
    "token": rf"(?<![A-Za-z0-9]){_TOKEN}",
    "card": rf"(?<![\d.])\d(?:\d|-\d| (?!{_SSN}|{_IP}|{_TOKEN})\d){{12,}}+",
    "ip": rf"(?<![\d.]){_IP}",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|(?i:fe80):(?::{_HEX}){{1,7}})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9_]){SECRETS}[A-Za-z0-9_\-]{{16,}}+",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?<=[=:\s\"'])(?<=(?i:password|passwd|pwd)\s{0,3}[=:]\s{0,8}[\"']?)[^\s\"'<>=:]{4,}+",
    "name": rf"(?<![{_WORD}])(?:(?:{'|'.join([*MALE, *FEMALE, *NEUTRAL])})\.?) {_INITIALS}{_NAME}(?:[ \-]{_INITIALS}{_NAME}){{0,2}}(?![{_WORD}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLED = rf"(?:{'|'.join([*MALE, *FEMALE, *NEUTRAL])})\.? "
_TITLE = f"^{_TITLED}"
#: In a text with names, words in a row that may be parts of one.
_PLAIN = rf"(?!{_TITLED}){_NAME}(?:[ \-]{_INITIALS}(?!{_TITLED}){_NAME}){{0,3}}"
PATTERN_NAMED = rf"{PATTERN}|(?<![{_WORD}]){_PLAIN}(?![{_WORD}])"
#: Capitalised words that open sentences, and no first names.
OPENERS = (
    "a after al also als am an and as at auf aus before bei but by como con con da dans das de del der des die dear did does doch don el ella er es et for from "
    "hello hi how if il im in is it la las le les liebe lieber los mais mit no nach non on or our para pero por quand que she he sie so that the then there they "
    "this to today und une un una unser vom von was we wenn what when where while who why with yesterday you your zu в и к на но о он она по с у что я"
).split()
_CYRILLIC = r"\p{IsCyrillic}"


def _luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, the last one not."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _kind(mention: Column) -> Column:
    out = F.when(F.regexp_like(mention, F.lit(f"^(?:{PATTERNS['email']})$")), "email")
    for name in ("name", "phone", "ssn", "token", "card", "ip", "ipv6", "iban", "secret", "access"):
        out = out.when(F.regexp_like(mention, F.lit(f"^(?:{PATTERNS[name]})$")), name)
    return out.otherwise("password")


def _name_words(mention: Column) -> Column:
    """The words of a name and what is between them, in order."""
    return F.regexp_extract_all(mention, F.lit(r"[\p{L}'’]+|[^\p{L}'’]+"), F.lit(0))


_LONG_WORD = r"^[\p{L}'’]{2,}$"


def _name_pieces(mention: Column) -> Column:
    """Of a name after a form of address each word of two letters or more, and what is between them. The first of several words may have a gender."""
    title = F.regexp_extract(mention, _TITLE, 0)
    gender = F.when(F.regexp_like(title, F.lit(rf"^(?:{'|'.join(MALE)})\.? $")), "m").when(F.regexp_like(title, F.lit(rf"^(?:{'|'.join(FEMALE)})\.? $")), "f")
    rest = _name_words(F.substr(mention, F.length(title) + 1))
    word = F.lit(_LONG_WORD)
    several = F.size(F.filter(rest, lambda t: F.regexp_like(t, word))) > 1
    words = F.transform(rest, lambda t, i: _piece(F.when(F.regexp_like(t, word), "name"), t, F.when((i == 0) & several, gender)))
    return F.concat(F.array(_piece(None, title)), words)


def _plain_words(mention: Column, names: Column) -> Column:
    """Which words of a row of capitalised words, in lower case, are names: known ones, and one right before a known one that opens no sentence."""
    words = F.filter(_name_words(F.lower(mention)), lambda t: F.regexp_like(t, F.lit(_LONG_WORD)))
    opener = F.array(*[F.lit(x) for x in OPENERS])
    follows = lambda i: F.array_contains(names, F.get(words, i + 1))
    return F.filter(words, lambda t, i: F.array_contains(names, t) | (F.coalesce(follows(i), F.lit(False)) & ~F.array_contains(opener, t)))


def _plain_pieces(mention: Column, words: Column) -> Column:
    return F.transform(_name_words(mention), lambda t: _piece(F.when(F.array_contains(words, F.lower(t)), "name"), t))


def _piece(kind: str | Column | None, piece: Column, gender: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.cast("string").alias("kind"), piece.alias("piece"), (F.lit(None) if gender is None else gender).cast("string").alias("gender"))


def _mod97(text: Column) -> Column:
    """The number that digits and capitals (of two digits each) make, modulo 97."""
    one = lambda a, c: F.when(F.regexp_like(c, F.lit("[0-9]")), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(one(a, c)))


def _pieces(kind: Column, mention: Column) -> Column:
    """A mention as an array of (kind, piece, gender); pieces with no kind stay as they are."""
    at = F.instr(mention, "@")
    mail = F.array(_piece("local", F.substr(mention, F.lit(1), at - 1)), _piece(None, F.lit("@")), _piece("domain", F.substr(mention, at + 1)))
    compact = F.regexp_replace(mention, " ", "")
    sound = _mod97(F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))) == 1
    iban = F.array(_piece(F.when(sound, "iban"), mention))
    return F.when(kind == "card", _card_pieces(mention)).when(kind == "name", _name_pieces(mention)).when(kind == "email", mail).when(kind == "iban", iban).otherwise(F.array(_piece(kind, mention)))


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.regexp_like(digits, F.lit(ISSUERS)) & (_luhn_sum(digits) % 10 == 0)


def _short_card_pieces(run: Column) -> Column:
    """Of a run of 19 digits at most: its card, and with no kind what is beside it.

    Groups of the usual sizes come first, then the whole run, then rows of groups of three digits or more. Two cards have no room in it.
    """
    groups = F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0))
    last = F.size(groups) - 1

    def row(i: Column, j: Column) -> Column:
        part = F.slice(groups, i + 1, j - i + 1)
        shape = F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-")
        rank = F.when((i == j) | shape.isin(GROUPINGS), 0).when((i == 0) & (j == last), 1).when(F.forall(part, lambda g: F.length(g) >= 3), 2)
        return F.struct(rank.alias("rank"), i.alias("i"), (-j).alias("k"), F.array_join(part, "").alias("digits"))

    rows = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: row(i, j))))
    best = F.array_min(F.filter(rows, lambda x: x["rank"].isNotNull() & _is_card(x["digits"])))
    before = lambda i: F.length(F.array_join(F.slice(groups, 1, i), "-")) + F.when(i > 0, 1).otherwise(0)
    a, b = before(best["i"]), before(-best["k"] + 1) - F.when(-best["k"] < last, 1).otherwise(0)
    parts = F.array(_piece(None, F.substr(run, F.lit(1), a)), _piece("card", F.substr(run, a + 1, b - a)), _piece(None, F.substr(run, b + 1)))
    return F.when(best.isNull(), F.array(_piece(None, run))).otherwise(parts)


#: A row of groups of 3 to 19 digits, as long as it goes, and what lies between such rows in a run.
_GROUPED = r"(?<![0-9])[0-9]{3,19}(?![0-9])(?:[ \-][0-9]{3,19}(?![0-9]))*+"
_BETWEEN = r"(?:[ \-]|(?<![0-9])(?![0-9]{3,19}(?![0-9]))[0-9]++)++"
#: Groups that a card in such a row has at most, and marks for cards of so many groups; ``z`` marks no card.
_MOST, _MARKS = 6, "abcdef"
_FOUND = "|".join(f"{m}[0-9]+[ \\-]?(?:[a-z][0-9]+[ \\-]?){{{n}}}" for n, m in enumerate(_MARKS)) + r"|z[0-9]+[ \-]?"


def _shapes(n: int, usual: bool) -> list[str]:
    """What n groups of a card look like: the usual sizes, or any of three digits or more."""
    if not usual:
        return [rf"^[0-9]{{3,19}}(?:[ \-][0-9]{{3,19}}){{{n - 1}}}(?![0-9])"]
    sizes = [x.split("-") for x in GROUPINGS] if n > 1 else [["13,19"]]
    return [r"^" + r"[ \-]".join(rf"[0-9]{{{k}}}" for k in x) + "(?![0-9])" for x in sizes if len(x) == n]


def _cut_cards(row: Column, usual: bool) -> Column:
    """A row of groups as strings in turn: what is no card, a card, what is no card, and so on.

    Each group gets the mark of the longest card that begins with it, of the usual sizes or of any. Read from left to right, a mark takes its groups with it.
    """
    # Of each group the string of itself and the groups after it, so that nothing looks into an array of the whole row.
    heads = F.regexp_extract_all(row, F.lit(rf"(?<![0-9])(?=((?:[0-9]+[ \-]?){{1,{_MOST}}}))[0-9]"), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"[ \-]", "")

    def mark(head: Column) -> Column:
        out = F.lit("z")
        for n in range(1, _MOST + 1):
            for shape in _shapes(n, usual):
                out = F.when(_is_card(plain(F.regexp_extract(head, shape, 0))), _MARKS[n - 1]).otherwise(out)
        return F.when(F.regexp_like(plain(head), F.lit(ISSUERS)), out).otherwise("z")

    each = F.transform(heads, lambda h: F.concat(mark(h), F.regexp_extract(h, r"^[0-9]+[ \-]?", 0)))
    marked = F.concat(F.regexp_extract(row, r"^[ \-]", 0), F.array_join(each, ""))
    # A separator in front of the first group has no mark; it stays in front.
    found = F.regexp_extract_all(marked, F.lit(rf"{_FOUND}|[ \-]"), F.lit(0))
    card = lambda t: F.concat(F.lit("|"), F.regexp_replace(t, r"[a-z]|[ \-]$", ""), F.lit("|"), F.regexp_extract(t, r"[ \-]$", 0))
    each = F.transform(found, lambda t: F.when(F.regexp_like(t, F.lit(r"^[a-f]")), card(t)).otherwise(F.regexp_replace(t, "^z", "")))
    return F.split(F.array_join(each, ""), "[|]", -1)


def _long_card_pieces(run: Column) -> Column:
    """Of a run of more than 19 digits: all cards of the usual groups, from left to right, and then cards of other groups in what is left."""
    alternately = lambda parts, other: F.flatten(F.transform(parts, lambda x, k: F.when(k % 2 == 1, F.array(_piece("card", x))).otherwise(other(x))))
    single = lambda x: F.array(_piece(None, x))
    enough = lambda x: F.length(x) >= 13
    again = lambda x: F.when(enough(x), alternately(_cut_cards(x, False), single)).otherwise(single(x))
    rows = F.regexp_extract_all(run, F.lit(f"{_GROUPED}|{_BETWEEN}"), F.lit(0))
    cut = F.transform(rows, lambda x: F.when(enough(x) & F.regexp_like(x, F.lit(f"^{_GROUPED}$")), alternately(_cut_cards(x, True), again)).otherwise(single(x)))
    return F.flatten(cut)


def _card_pieces(run: Column) -> Column:
    """A run of digits as an array of (kind, piece): its cards, and with no kind what is between them.

    A card is a row of whole groups with 13 to 19 digits and a valid check digit. In a long run its groups have three digits or more.
    """
    return F.when(F.length(F.regexp_replace(run, r"[^0-9]", "")) <= 19, _short_card_pieces(run)).otherwise(_long_card_pieces(run))


def _normal(kind: Column, piece: Column) -> Column:
    digits = F.regexp_replace(piece, r"\D", "")
    return (
        F.when(kind == "phone", F.regexp_replace(digits, r"^1(?=\d{10}$)", ""))  # the same number with and without its country code
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(piece, " ", ""))
        .when(kind.isin("password", "secret"), piece)
        .otherwise(F.lower(piece))
    )


def _draw(i: Column, seed: Column) -> Column:
    """A number from 0 to 255 for each place, from a seed of 128 hex digits."""
    return F.conv(F.substr(seed, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(of: str, n: Column) -> Column:
    return F.substr(F.lit(of), n % len(of) + 1, F.lit(1))


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUSSIAN = "абвгдежзиклмнопрстуфхцчшэюя"


def _characters(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by one of its class."""
    low, up = (_LOW[:6], _UP[:6]) if hexadecimal else (_LOW, _UP)

    def one(c: Column, i: Column) -> Column:
        n = _draw(i, seed)
        return (
            F.when(F.regexp_like(c, F.lit("[0-9]")), _pick("0123456789", n)).when(F.regexp_like(c, F.lit("[A-Z]")), _pick(up, n)).when(F.regexp_like(c, F.lit("[a-z]")), _pick(low, n))
            .when(F.regexp_like(c, F.lit(_CYRILLIC)), _pick(_RUSSIAN, n)).when(F.regexp_like(c, F.lit(r"\p{L}")), _pick(_LOW, n)).when(F.regexp_like(c, F.lit(r"\p{N}")), _pick("0123456789", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _name(normal: Column, gender: Column, seed: Column, syllables: int) -> Column:
    """Syllables of the word's script, with its gender's ending."""
    cyrillic = F.regexp_like(normal, F.lit(_CYRILLIC))

    def word(consonants: str, vowels: str) -> Column:
        return F.concat(*[_pick(x, _draw(F.lit(2 * j + k), seed)) for j in range(syllables) for k, x in enumerate((consonants, vowels))])

    female = (gender == "f") | (cyrillic & F.regexp_like(normal, F.lit("[ая]$")))
    end = F.when(female, F.when(cyrillic, "на").otherwise("na")).when(gender == "m", F.when(cyrillic, "н").otherwise("n")).otherwise("")
    return F.concat(F.initcap(F.when(cyrillic, word("бвгдзклмнпрст", "аеиоу")).otherwise(word("bdfgklmnprstvz", "aeiou"))), end)


def seed_of(kind: Column, normal: Column, attempt: int, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), normal), 512)


def surrogate(kind: Column, normal: Column, gender: Column, seed: Column, attempt: int) -> Column:
    """``seed`` is a column that is there already: it is read once for each character."""
    chars = _characters(normal, seed)
    stem = F.concat(F.substring(normal, 1, 4), F.substr(chars, F.lit(5), F.length(normal) - 5))
    check = F.pmod(-_luhn_sum(F.concat(F.when(kind == "card", stem).otherwise("0"), F.lit("0"))), F.lit(10))
    ending = F.regexp_extract(normal, r"\.[^.]*$", 0)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(i, seed) % 254 + 1).cast("string")), ".")
    country = F.when(F.length(normal) > 10, F.length(normal) - 10).otherwise(0)
    nation, account = F.substring(normal, 1, 2), F.substr(chars, F.lit(5))
    two = F.lpad((98 - _mod97(F.when(kind == "iban", F.concat(account, nation, F.lit("00"))).otherwise("0"))).cast("string"), 2, "0")
    prefix = F.length(F.regexp_extract(normal, f"^{SECRETS}", 0))
    return (
        F.when(kind == "card", F.concat(stem, check.cast("string")))
        .when(kind == "phone", F.concat(F.substr(normal, F.lit(1), country), F.substr(chars, country + 1)))
        .when(kind == "domain", F.concat(F.substr(chars, F.lit(1), F.length(normal) - F.length(ending)), ending))
        .when(kind == "ip", octets)
        .when(kind == "iban", F.concat(nation, two, account))
        .when(kind == "secret", F.concat(F.substr(normal, F.lit(1), prefix), F.substr(chars, prefix + 1)))
        .when(kind == "access", F.concat(F.substring(normal, 1, 4), F.substr(chars, F.lit(5))))
        .when(kind.isin("token", "ipv6"), _characters(normal, seed, True))
        .when(kind == "name", _name(normal, gender, seed, 3 + attempt // 4))
        .otherwise(chars)
    )


def assigned(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(_kind, _normal, _new) with different surrogates for the different entities (_kind, _normal), none of them an entity.

    Rows with a column ``_gender`` are counted: the more frequent one is the entity's.
    """
    votes = F.sum(F.when(F.col("_gender") == "f", 1).when(F.col("_gender") == "m", -1).otherwise(0)) if "_gender" in entities.columns else F.lit(0)
    gender = F.when(votes > 0, "f").when(votes < 0, "m").otherwise("")
    entities = stored(entities.groupBy("_kind", "_normal").agg(gender.alias("_gender")), "entities")
    pending, done = entities, None
    for attempt in range(rounds):
        seeded = pending.withColumn("_seed", seed_of(F.col("_kind"), F.col("_normal"), attempt, key))
        new = surrogate(F.col("_kind"), F.col("_normal"), F.col("_gender"), F.col("_seed"), attempt)
        tried = seeded.select("_kind", "_normal", new.alias("_new"))
        first = F.row_number().over(Window.partitionBy("_kind", "_new").orderBy("_normal"))
        taken = entities.select("_kind", F.col("_normal").alias("_new"))
        taken = taken if done is None else taken.unionByName(done.select("_kind", "_new"))
        good = tried.withColumn("_k", first).where("_k = 1").drop("_k").join(taken.select("_kind", F.lower("_new").alias("_low")).distinct(), (F.lower("_new") == F.col("_low")) & (tried["_kind"] == taken["_kind"]), "left_anti")
        good = stored(good.select("_kind", "_normal", "_new"), f"surrogates{attempt}")
        done = good if done is None else done.unionByName(good)
        pending = stored(pending.join(good, ["_kind", "_normal"], "left_anti"), f"pending{attempt}")
        if pending.isEmpty():
            return done
    tag = F.concat(F.lit("["), F.col("_kind"), F.lit("-"), F.sha2(F.concat_ws("|", F.lit(key), "_kind", "_normal"), 256), F.lit("]"))
    return done.unionByName(pending.select("_kind", "_normal", tag.alias("_new")))


def _formatted(kind: Column, piece: Column, new: Column) -> Column:
    """A surrogate in a mention's separators and case. Digits before as many as the surrogate has stay."""
    each = F.when(kind == "iban", "[0-9A-Z]").otherwise("[0-9]")
    before = F.length(new) - F.length(F.regexp_replace(piece, F.concat(F.lit("[^"), F.substring(each, 2, 99)), F.lit("")))
    spread = F.aggregate(
        F.split(piece, ""), F.struct(F.lit("").alias("s"), (before + 1).alias("i")),
        lambda a, c: F.when(F.regexp_like(c, each), F.struct(F.concat(a["s"], F.when(a["i"] > 0, F.substr(new, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: a["s"],
    )
    capital = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    cased = lambda c, n: F.when(c.isNull(), "").when(capital(c), F.upper(F.coalesce(n, F.lit("")))).otherwise(F.coalesce(n, F.lit("")))
    by_place = F.array_join(F.zip_with(F.split(piece, ""), F.split(new, ""), cased), "")
    name = F.when(capital(piece), F.upper(new)).otherwise(new)
    return (
        F.when(F.startswith(new, F.lit("[")), new).when(kind.isin("phone", "ssn", "card", "iban"), spread).when(kind == "name", name)
        .when(kind.isin("local", "domain", "token", "ipv6", "access"), by_place).otherwise(new)
    )


def may_hold(text: Column) -> Column:
    """Quickly seen, and true of all texts with a mention: each pattern needs one of these."""
    may = F.regexp_like(text, F.lit("[\\p{N}@]|(?i:pass|pwd)|A(?:KI|SI)A|[a-f]{40}|[A-F]{40}|_live_|_test_|gh[pousr]_|xox[abprs]-|AIza|[a-fA-F]:[a-fA-F]"))
    for title in [*MALE, *FEMALE, *NEUTRAL]:
        may |= F.contains(text, F.lit(f"{title} ")) | F.contains(text, F.lit(f"{title}. "))
    return may


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts, and the number of mentions in the column ``count`` if asked for."""
    text = F.col(text_col)
    has = F.coalesce(F.when(may_hold(text), F.regexp_like(text, F.lit(PATTERN))).otherwise(F.lit(False)), F.lit(False))
    row = [F.col(id_col).alias("_pii_id"), F.xxhash64(whole_text(text_col)).alias("_pii_text")]
    dirty = docs.where(has).select("*", *row, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("_pii_found"))
    titled = F.filter("_pii_found", lambda m: F.regexp_like(m, F.lit(f"^(?:{PATTERNS['name']})$")))
    words = F.array_distinct(F.flatten(F.transform(titled, lambda m: F.regexp_extract_all(F.lower(F.regexp_replace(m, _TITLE, "")), F.lit(r"[\p{L}'’]{2,}"), F.lit(0)))))
    dirty = dirty.withColumn("_pii_names", words).withColumn("_pii_pattern", F.when(F.size("_pii_names") > 0, PATTERN_NAMED).otherwise(PATTERN))
    dirty = dirty.withColumn("_pii_found", F.when(F.size("_pii_names") > 0, F.regexp_extract_all(text, F.col("_pii_pattern"), F.lit(0))).otherwise(F.col("_pii_found")))
    dirty = stored(dirty, "mentions")
    clean = docs.where(~has)
    plain = lambda m: F.regexp_like(m, F.lit(f"^{_PLAIN}$"))
    each = dirty.select("_pii_id", "_pii_text", "_pii_names", F.explode(F.array_distinct("_pii_found")).alias("_m"))
    each = each.withColumn("_words", F.when((F.size("_pii_names") > 0) & plain(F.col("_m")), _plain_words(F.col("_m"), F.col("_pii_names"))))
    each = each.where("_words IS NULL OR size(_words) > 0").select("_pii_id", "_pii_text", "_m", "_words").distinct()
    each = each.withColumn("_kind", F.when(F.col("_words").isNotNull(), "name").otherwise(_kind(F.col("_m"))))
    pieces = F.when(F.col("_words").isNotNull(), _plain_pieces(F.col("_m"), F.col("_words"))).otherwise(_pieces(F.col("_kind"), F.col("_m")))
    each = each.withColumn("_pieces", pieces)
    # From here on a mention goes by its digest: one with very many pieces is not carried along with each of them.
    each = each.select("_pii_id", "_pii_text", F.sha2("_m", 256).alias("_key"), "_pieces")
    each = each.select("_pii_id", "_pii_text", "_key", F.posexplode("_pieces").alias("_at", "_p"))
    each = each.select("_pii_id", "_pii_text", "_key", "_at", F.col("_p.kind").alias("_kind"), F.col("_p.piece").alias("_piece"), F.col("_p.gender").alias("_gender"))
    each = stored(each.withColumn("_normal", _normal(F.col("_kind"), F.col("_piece"))), "each")
    found = each.where("_kind IS NOT NULL")
    named = found.join(assigned(found.select("_kind", "_normal", "_gender"), key), ["_kind", "_normal"]).withColumn("_s", _formatted(F.col("_kind"), F.col("_piece"), F.col("_new")))
    columns = ["_pii_id", "_pii_text", "_key", "_at", "_s"]
    named = named.select(*columns, F.lit(1).alias("_n"), (F.col("_kind") == "card").cast("int").alias("_cards"))
    named = named.unionByName(each.where("_kind IS NULL").select(*columns[:-1], F.col("_piece").alias("_s"), F.lit(0).alias("_n"), F.lit(0).alias("_cards")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]), "")
    named = named.groupBy("_pii_id", "_pii_text", "_key").agg(whole.alias("_s"), F.greatest(F.max("_n"), F.sum("_cards")).alias("_n"))
    # By place, so that a text with very many mentions takes work in proportion to them.
    row_of = ["_pii_id", "_pii_text"]
    places = dirty.select(*row_of, F.posexplode("_pii_found").alias("_i", "_m")).distinct()
    match = places["_pii_id"].eqNullSafe(named["_pii_id"]) & (places["_pii_text"] == named["_pii_text"]) & (F.sha2(places["_m"], 256) == named["_key"])
    filled = places.join(named, match, "left").select(*[places[c] for c in (*row_of, "_i")], F.coalesce("_s", "_m").alias("_s"), F.coalesce("_n", F.lit(0)).alias("_n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"])
    filled = filled.groupBy(F.col("_pii_id").alias("_new_id"), F.col("_pii_text").alias("_new_text"))
    news = filled.agg(in_order.alias("_pii_new"), F.sum("_n").cast("long").alias("_pii_count"))
    joined = dirty.join(news, F.col("_pii_id").eqNullSafe(F.col("_new_id")) & (F.col("_pii_text") == F.col("_new_text")), "left")
    parts = F.split(text, F.col("_pii_pattern"), -1)
    changed = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get("_pii_new", i), F.lit("")))), "")
    out = [F.when(F.col("_pii_count") > 0, changed).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    counted = [F.coalesce("_pii_count", F.lit(0).cast("long")).alias(count)] if count else []
    return clean.select("*", *([F.lit(0).cast("long").alias(count)] if count else [])).unionByName(joined.select(*out, *counted))
