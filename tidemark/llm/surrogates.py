"""Replace personal data by keyed surrogates, natively.

One regular expression finds entities, once per text. Each distinct entity gets
a surrogate of its own type and format from keyed hashes: digits become other
digits, letters other letters of the same case and script, cards keep their
check digit valid, addresses keep valid octets. No letter or digit stays in its
place, whatever its script.

Names are replaced part by part, so that a surname is the same wherever it
stands: "Mrs. Anna Smith", "Mr. Smith" and "Dr. Smith" corefer. Given names take
the gender of their form of address; beside Dr and Prof they take the gender
that the corpus gives that name elsewhere, or that a Slavic or Greek surname
tells.

Surrogates that two entities share, or that are some entity of the corpus
themselves, are drawn again, longer after a few rounds, until all are distinct.

Only documents with an entity are shuffled; the table of distinct entities
grows with the entities, not with the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import col, cut, may_be_among

# Forms of address, by gender, and the forms of identifiers.
MALE = "Mr Mister Sir Herr Herrn Señor Sr Monsieur Господин господин г-н Κύριος κύριος".split()
FEMALE = "Mrs Ms Miss Madam Frau Señora Señorita Sra Srta Madame Mme Mademoiselle Mlle Госпожа госпожа г-жа Κυρία κυρία".split()
NEUTRAL = "Dr Prof Professor".split()
TITLES = "|".join([*MALE, *FEMALE, *NEUTRAL])
SECRET_NAMES = "password|passwd|passphrase|pwd|secret|token|api_key|apikey|api-key|access_key|auth_key|private_key"

# Every branch first asks for a character that is cheap to rule out; most of a text goes by at that.
# Java matches a repeated group by recursion, so every such group has a bound (a domain has 127 labels at
# most), and only single character classes repeat without one: no text exhausts a thread's stack.
TITLE_STARTS = "".join(sorted({t[0] for t in [*MALE, *FEMALE, *NEUTRAL]}))
NAME = rf"(?=[{TITLE_STARTS}])(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}][\p{L}\p{N}-]*+\.){1,126}\p{L}{2,}"
KEY = r"(?=[Ags])(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
KEY_STARTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
SECRET = (
    r"(?<=[\s\"':=])(?<=[:=]\s{0,2}[\"']?)"
    rf"(?<=(?<![\p{{L}}\p{{N}}])(?i:{SECRET_NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)[^\s\"'<>,;]{{6,}}"
)
IBAN = r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PEM = r"(?=-)-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----[^-]++-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"
JWT = r"(?=e)(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+"
IPV6 = (
    r"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
)
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]?\d)"
PHONE = (
    r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
)
PATTERN = "|".join([SECRET, PEM, JWT, KEY, EMAIL, IBAN, IPV6, rf"(?=[0-9+(])(?:{IP}|{SSN}|{PHONE}|{CARD})", NAME])
NAMED = rf"(?=[{TITLE_STARTS}])(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? \p{{Lu}}"
ASSIGNED = rf"(?i:{SECRET_NAMES})[\"']?\s{{0,2}}[:=]"

def _run(first: int, count: int) -> str:
    return "".join(map(chr, range(first, first + count)))


#: Letters that stand for letters, by script and case; a script's own come before the catch-alls.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщыэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
SCRIPTS = [
    (r"\p{IsHan}", _run(0x4E00, 180)),
    (r"\p{IsHiragana}", _run(0x3042, 80)),
    (r"\p{IsKatakana}", _run(0x30A2, 80)),
    (r"\p{IsHangul}", _run(0xAC00, 180)),
    (r"\p{IsArabic}", _run(0x0628, 18)),
    (r"\p{IsHebrew}", _run(0x05D0, 27)),
    (r"\p{IsDevanagari}", _run(0x0915, 36)),
    (r"\p{IsThai}", _run(0x0E01, 46)),
    (r"\p{IsArmenian}", _run(0x0561, 38)),
    (r"\p{IsGeorgian}", _run(0x10D0, 33)),
    (r"(?=\p{IsCyrillic})\p{Lu}", ALPHABETS[4]),
    (r"\p{IsCyrillic}", ALPHABETS[3]),
    (r"(?=\p{IsGreek})\p{Lu}", ALPHABETS[6]),
    (r"\p{IsGreek}", ALPHABETS[5]),
    (r"\p{Lu}", ALPHABETS[2]),
    (r"\p{L}", ALPHABETS[1]),
    (r"\p{N}", ALPHABETS[0]),
]
HEX, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
#: Consonants, vowels and endings (male, female, neither) of invented names by script: given names, then family names.
NAME_SOUNDS = [
    (r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеиоу", ("ан", "ана", "ен"), ("ов", "ова", "ко")),
    (r"\p{IsGreek}", "βγδκλμνπρστ", "αειου", ("ος", "α", "ις"), ("ης", "η", "ου")),
    (r"\p{IsLatin}", "bdfgklmnprstvz", "aeiou", ("on", "ina", "is"), ("er", "er", "er")),
]
MALE_ENDING, FEMALE_ENDING = r"(?:ов|ев|ёв|ин|ын|ий|ης|ος)$", r"(?:ова|ева|ёва|ина|ына|ая|ου)$"
#: Rounds of drawing; surrogates grow from the fourth on, so that room never runs out.
ROUNDS = 40
#: Entities that one task draws surrogates for.
TASK_ENTITIES = 2000


def _bytes(key: str, *parts: Column) -> Column:
    """256 keyed bytes, as hex, of the parts."""
    seed = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 512) for i in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (2 * (i % 250) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _letter(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), (b % len(alphabet) + 1).cast("int"), F.lit(1))


def _redrawn(text: Column, stream: Column) -> Column:
    """Every letter and digit by another of its case and script, marks on letters left out; hex stays hex; the rest stays."""

    def whole(t: Column) -> Column:
        return F.array_join(F.transform(t["letters"], lambda c, i: one(t, c, i)), "")

    def one(t: Column, c: Column, i: Column) -> Column:
        letters = F.when(t["lower"] & (c != ":"), HEX).when(t["upper"] & (c != ":"), HEX_UPPER)
        for alphabet in ALPHABETS:
            letters = letters.when(F.instr(F.lit(alphabet), c) > 0, alphabet)
        letters = letters.when(c.rlike(r"^(?:[\x00-\x7f]|\p{M})$"), "")
        for pattern, alphabet in SCRIPTS:
            letters = letters.when(c.rlike(f"^{pattern}$"), alphabet)
        other = lambda a: F.substr(a, ((F.instr(a, c) + _byte(t["stream"], i) % (F.length(a) - 1)) % F.length(a) + 1).cast("int"), F.lit(1))
        kept = F.when(c.rlike(r"^\p{M}$"), "").otherwise(c)
        return let(F.coalesce(letters, F.lit("")), lambda a: F.when(a == "", kept).otherwise(other(a)))

    lower, upper = text.rlike("^[0-9a-f:]{12,}$") & text.rlike("[a-f]"), text.rlike("^[0-9A-F:]{12,}$") & text.rlike("[A-F]")
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))  # once; substr would count from the start each time
    return let(F.struct(letters.alias("letters"), stream.alias("stream"), lower.alias("lower"), upper.alias("upper")), whole)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def kind(entity: Column) -> Column:
    """An entity's type, told from its form."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(whole(NAME), "name").when(whole(EMAIL), "email").when(whole(PEM), "pem").when(whole(JWT), "jwt")
        .when(whole(KEY), "key").when(whole(IBAN), "iban").when(whole(IP), "ip").when(whole(IPV6), "ip6")
        .when(whole(SSN), "ssn").when(whole(PHONE), "phone").when(whole(CARD), "card").otherwise("secret")
    )


def surrogate(entity: Column, of_kind: Column, key: str, attempt: int) -> Column:
    """The keyed surrogate of an entity, other than a name, on that attempt."""
    more = max(0, attempt - 3)  # the format has no room left: a few characters more of the last one's sort
    longer = F.concat(entity, F.repeat(F.substr(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""), F.lit(-1), F.lit(1)), F.lit(more))) if more else entity
    stream = _bytes(key, of_kind, entity, F.lit(str(attempt)))
    drawn = let(stream, lambda s: F.struct(s.alias("stream"), _redrawn(longer, s).alias("text")))
    return let(drawn, lambda d: _formed(entity, of_kind, key, attempt, more, d["stream"], d["text"]))


def _formed(entity: Column, of_kind: Column, key: str, attempt: int, more: int, stream: Column, redrawn: Column) -> Column:
    """What its type keeps of an entity, and the rest redrawn."""

    user, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    kept = F.regexp_extract(domain, r"(?i)(?:\.|^)(?:example\.(?:com|org|net|edu)|[a-z]{2,})$", 0)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(kept))
    user_longer = F.concat(user, F.repeat(F.lit("x"), F.lit(more))) if more else user
    email = F.concat(
        _redrawn(user_longer, stream),
        F.lit("@"),
        F.when(F.length(host) > 0, _redrawn(host, _bytes(key, F.lit("domain"), domain))).otherwise(""),
        kept,
    )
    octets = F.split(entity, r"\.")

    def octet(o: Column, i: Column) -> Column:
        b = _byte(stream, 2 * i)
        if attempt >= 2:  # one-digit octets leave little room
            return (b % 223 + 1).cast("string")
        by_length = F.when(F.length(o) == 1, b % 9 + 1).when(F.length(o) == 2, b % 90 + 10).otherwise(b % 124 + 100)
        return by_length.cast("string")

    ip = F.array_join(F.transform(octets, octet), ".")
    # the country code stays, and the exchange 555 that no real subscriber has
    code = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(code, F.substr(redrawn, F.length(code) + 1))
    exchange = F.regexp_instr(entity, F.lit(r"(?<!\d)555[ .-]?\d{4}$"))
    phone = F.when(exchange > 0, F.overlay(phone, F.lit("555"), exchange)).otherwise(phone)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    front = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(redrawn, F.lit(2), F.length(entity) - 2))
    check = (10 - _luhn(F.concat(F.regexp_replace(front, "[^0-9]", ""), F.lit("0")))) % 10
    card = F.concat(
        front, F.when(_luhn(digits) == 0, check.cast("string")).otherwise(F.substr(redrawn, F.length(entity)))
    )
    if more:
        card = redrawn
    prefix = F.regexp_extract(entity, r"^(?:AKIA|ASIA|gh[pousr]_|sk-|eyJ)", 0)
    secret_key = F.concat(prefix, F.substr(redrawn, F.length(prefix) + 1))
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.substr(redrawn, F.lit(3)))
    first, last = F.regexp_extract(entity, r"^-----[A-Z ]+-----", 0), F.regexp_extract(entity, r"-----[A-Z ]+-----$", 0)
    body = F.substr(redrawn, F.length(first) + 1, F.length(entity) - F.length(first) - F.length(last))
    pem = F.concat(first, body, F.repeat(F.lit("A"), F.lit(more)), last)
    return (
        F.when(of_kind == "email", email).when(of_kind == "ip", ip).when(of_kind == "phone", phone)
        .when(of_kind == "card", card).when(of_kind.isin("key", "jwt"), secret_key).when(of_kind == "iban", iban)
        .when(of_kind == "pem", pem).otherwise(redrawn)
    )


def _root(part: Column, key: str, attempt: int) -> Column:
    """The stem of an invented name in the script of that part of a name; parts of other scripts are redrawn."""
    stream = _bytes(key, F.lit("name"), part, F.lit(str(attempt)))
    out = None
    for script, hard, soft, _, _ in NAME_SOUNDS:
        sounds = [_letter(soft if j % 2 else hard, _byte(stream, F.lit(2 * j))) for j in range(5 + 2 * attempt)]
        made = F.concat(F.initcap(sounds[0]), *sounds[1:])
        out = (F.when if out is None else out.when)(part.rlike(script), made)
    return out.otherwise(_redrawn(F.concat(part, F.repeat(F.substr(part, F.lit(-1), F.lit(1)), F.lit(attempt))), stream))


def _words(part: Column, root: Column) -> Column:
    """All words that a root may become: given names male, female, neither; family names likewise."""
    out = None
    for script, _, _, given, family in NAME_SOUNDS:
        made = F.array(*[F.concat(root, F.lit(end)) for end in (*given, *family)])
        out = (F.when if out is None else out.when)(part.rlike(script), made)
    return out.otherwise(F.array_repeat(root, 6))


def _spread(entities: DataFrame) -> DataFrame:
    """As many tasks as there is work, though few bytes."""
    return entities.repartition(max(1, -(-entities.count() // TASK_ENTITIES)), entities.columns[0])


def assign(entities: DataFrame, drawn_by, words_of, taken: DataFrame | None = None) -> DataFrame:
    """Distinct first column to itself and `surrogate`: all distinct, and none of their words among `taken` or the column itself.

    drawn_by(attempt) is the surrogate's expression, words_of its words as an
    array. An attempt's surrogate goes to the least that drew it, unless an
    earlier attempt gave it away; all others draw again.
    """
    name = entities.columns[0]
    todo = cut(_spread(entities))
    own = todo.select(F.col(name).alias("word"))
    taken = own if taken is None else own.union(taken)
    done = []
    for attempt in range(ROUNDS):
        drawn = cut(_spread(todo).withColumn("surrogate", drawn_by(attempt)).withColumn("words", words_of))
        held = drawn.select(name, F.explode(F.array_distinct("words")).alias("word")).join(taken, "word", "left_semi")
        least = drawn.groupBy("surrogate").agg(F.min(name).alias(name))
        won = cut(drawn.join(least, ["surrogate", name], "left_semi").join(held.select(name), name, "left_anti"))
        done.append(won.select(*entities.columns, "surrogate"))
        todo = cut(drawn.join(won.select(name), name, "left_anti").select(*entities.columns))
        if not todo.take(1):
            return reduce(DataFrame.unionByName, done)
        taken = taken.union(won.select(F.explode("words").alias("word")))
    raise RuntimeError("surrogates didn't settle")


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:{TITLES})\.? ", 0)


def _named(names: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) of names, from one surrogate per part of a name.

    Gender is the form of address's; beside a neutral one, the one that most
    addressed bearers of the given name have in the corpus, else what the
    surname's ending tells, else neither. A surname that is another's female
    form shares its root.
    """
    title = _title(F.col("entity"))
    bare = F.regexp_replace(F.col("title"), r"\.? $", "")
    told = (
        names.withColumn("title", title)
        .withColumn("parts", F.split(F.substr("entity", F.length("title") + 1), " "))
        .withColumn("given", F.when(F.size("parts") > 1, F.element_at("parts", 1)))
        .withColumn("addressed", F.when(bare.isin(*MALE), 0).when(bare.isin(*FEMALE), 1))
    )
    votes = told.where("given is not null and addressed is not null").groupBy("given").agg(F.avg("addressed").alias("female"))
    by_name = votes.select("given", F.when(F.col("female") > 0.5, 1).when(F.col("female") < 0.5, 0).alias("elsewhere"))
    last = F.element_at("parts", -1)
    ending = F.when(last.rlike(FEMALE_ENDING), 1).when(last.rlike(MALE_ENDING), 0)
    known = told.join(by_name, "given", "left").withColumn("gender", F.coalesce("addressed", "elsewhere", ending, F.lit(2)))
    stem = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=(?:ов|ев|ёв|ин|ын))а$", ""), r"ая$", "ий")
    each = cut(
        known.select("entity", "title", "gender", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
        .withColumn("stem", F.when(F.col("at") == F.col("n") - 1, stem(F.col("part"))).otherwise(F.col("part")))
    )
    words = each.select(F.explode(F.array("part", "stem")).alias("word")).distinct()
    roots = assign(
        each.select("stem").distinct(),
        lambda attempt: _root(F.col("stem"), key, attempt),
        _words(F.col("stem"), F.col("surrogate")),
        words,
    ).withColumnRenamed("surrogate", "root")
    at = F.when(F.col("at") == F.col("n") - 1, 4).otherwise(1) + F.col("gender")
    made = each.join(roots, "stem").withColumn("word", F.element_at(_words(F.col("stem"), F.col("root")), at))
    return made.groupBy("entity").agg(
        F.concat(F.first("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")).alias("surrogate")
    )


def given_to(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) for distinct entities."""
    kinds = cut(_spread(entities.select("entity")).withColumn("kind", kind(F.col("entity"))))
    others = assign(
        kinds.where("kind <> 'name'"),
        lambda attempt: surrogate(F.col("entity"), F.col("kind"), key, attempt),
        F.array("surrogate"),
    )
    return cut(others.select("entity", "surrogate").unionByName(_named(kinds.where("kind = 'name'").select("entity"), key)))


def may_match(text: Column) -> Column:
    """Whether a text can hold an entity at all, asked cheaply: most have neither digits nor '@', '=', keys or titles."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGNED)
    keys = reduce(Column.__or__, [text.contains(p) for p in [*KEY_STARTS, "eyJ", "-----BEGIN "]])
    return text.contains("@") | text.rlike("[0-9]") | secret | keys | text.rlike(NAMED)


def matched(text: Column) -> Column:
    """What looks like an entity, in order, repeats included; empty for null."""
    hits = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.coalesce(F.when(may_match(text), hits), F.array().cast("array<string>"))


def entities(matches: Column, text: Column) -> Column:
    """The distinct ones that are: long numbers need a valid check digit, unless they follow a secret's name in the text."""
    secrets = F.regexp_extract_all(text, F.lit(SECRET), F.lit(0))

    def real(e: Column) -> Column:
        return F.when(e.rlike(f"^(?:{CARD})$"), (let(F.regexp_replace(e, "[^0-9]", ""), _luhn) == 0) | F.array_contains(secrets, e)).otherwise(F.lit(True))

    return F.when(F.size(matches) > 0, F.filter(F.array_distinct(matches), real)).otherwise(F.array().cast("array<string>"))


def pseudonymize(docs: DataFrame, key: str = "tidemark", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Struct column `row` with all columns of docs, the text with surrogates, and n_replaced.

    Null and empty texts stay as they are. Rows without an id and repeated rows
    are treated each; equal texts get equal results. `key` is the secret: with
    another key all surrogates change. No rows in: no rows out. Column names
    never clash, as all travel in `row`.

    Texts are searched once; those that hold an entity are written aside. All
    others are told apart by a bitmap of bounded size, and only what it can't
    tell is searched again.
    """
    text = col(text_col)
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(col(id_col).cast("string"), text).alias("h")
    )
    found = entities(matched(F.col("text")), F.col("text"))
    hits = cut(
        rows.withColumn("matches", matched(F.col("text")))
        .withColumn("found", entities(F.col("matches"), F.col("text")))
        .where(F.size("found") > 0)
        .select("row", F.split("text", PATTERN, -1).alias("between"), "matches", "found", "h")
    )
    each = hits.select("h", F.explode("found").alias("entity"))
    given = given_to(each.select("entity").distinct(), key)
    maps = each.distinct().join(given, "entity").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("by"))
    woven = F.zip_with(
        "between",
        F.transform("matches", lambda e: F.coalesce(F.try_element_at(F.col("by"), e), e)),
        lambda kept, new: F.concat(kept, F.coalesce(new, F.lit(""))),
    )
    replaced = hits.join(maps, "h").select(
        F.col("row").withField("`" + text_col.replace("`", "``") + "`", F.array_join(woven, "")).alias("row"),
        F.size(F.filter("matches", lambda e: F.array_contains("found", e))).cast("long").alias("n_replaced"),
    )
    untouched = may_be_among(rows, hits.select("h"), "h", "maybe").where(~F.col("maybe") | (F.size(found) == 0))
    return untouched.select("row", F.lit(0).cast("long").alias("n_replaced")).unionByName(replaced)


def replace_private(docs: DataFrame, **how) -> DataFrame:
    """docs with surrogates in the text, columns unchanged. Nulls, empty texts, repeats and empty tables: as pseudonymize()."""
    return pseudonymize(docs, **how).select("row.*")
