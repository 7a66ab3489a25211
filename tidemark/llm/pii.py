"""Personal data replaced by surrogates of the same kind."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let, row_hash, split_listed

#: Titles by the gender they tell, and what surrogate names are built from, for each script.
TITLES = {
    "m": "Mr|Herr|Sr|Señor|Monsieur|Sir|Господин",
    "f": "Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Srta|Señora|Madame|Госпожа",
    "n": "Dr|Prof|Mx|Доктор",
}
#: How people name themselves, words that stand before a surname, and words that tell a thing rather than a person behind them.
CUES = "[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут"
PARTICLES = "von|van|der|den|de|del|della|di|da|dos|das|do|du|la|los|las|ter|ten|zu|af|av|bin|ibn|y"
ARTICLES = "the|The|a|A|an|An|this|This|that|That|his|her|its|their|our|my|your|no|any|each|every"
#: Names that are also words of a calendar, and names that are also common words.
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
COMMON = (
    "art baker banks bell best bill bishop black bond brook brown bush carter chance chase church clay cliff cook cooper cross dale dawn day dean drew earl english faith field fisher ford forest fox frank "
    "french gene grace grant gray green grey hall hill hope hunter iris ivy jack jean jewel joy king lake lane law lee lily little long love major mark marks mason miles mill moon north olive park parks "
    "pat penny pierce poole pope power powers price prince ray reed rich rob rock rose ruby sage sky small smith star stone street strong sue summer taylor violet wade walker ward waters west white will "
    "wise wolf wood woods young"
).split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mi na ne ni ra re ri sa se ta te ti va ve".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ке ла ле ло ма ме ми на не ни ра ре ри са се та те ти".split(),
    "greek": "βα βε γα γο δα δε κα κε λα λε μα με μι να νε ρα ρε σα σε τα τε τι".split(),
}
ENDINGS = {
    "latin": {"m": ["rik", "nus", "ton"], "f": ["ria", "lina", "sa"], "n": ["ri", "lin", "nay"], "surname": ["ner", "son", "mont", "vez"]},
    "cyrillic": {"m": ["слав", "мир", "тон"], "f": ["рина", "лия", "на"], "n": ["ри", "ли"], "surname": ["нов", "рин", "ченко"]},
    "greek": {"m": ["νος", "ρης"], "f": ["ρια", "να"], "n": ["ρι", "λι"], "surname": ["δης", "κος"]},
}

#: Within the lengths that addresses can have.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,200}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,10}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)"
#: Hexadecimal groups: all eight, or fewer with one :: among them.
IP6 = r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])"
#: North American numbers; any with a country code; French and German ones with their leading 0.
PHONE = (
    r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{4}|\+\d{1,3}(?:[ ./-]?\(?\d\)?){7,12}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8})(?!\d)"
)
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: Initials and particles before a name; behind them, and behind a title's full stop, a line may end.
LEAD = rf"(?:(?:\p{{Lu}}\.[ \t]*+|(?:{PARTICLES})(?:[ \t]++|(?=\n)))(?:\n[ \t]*+)?+){{0,4}}"
OPENING = rf"(?:{'|'.join(TITLES.values())})(?:\.?[ \t]+|\.[ \t]*+\n[ \t]*+)|(?:{CUES})(?:[ \t]++(?:\n[ \t]*+)?+|\n[ \t]*+)"
PERSON = rf"(?<![\p{{L}}])(?:{OPENING}){LEAD}{NAME}(?:[ \t]+{LEAD}{NAME}){{0,2}}"
#: In the order in which they are tried at a place.
KINDS = {"email": EMAIL, "ip": IP, "ip6": IP6, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _kind(mention: Column) -> Column:
    out = F.lit("person")
    for kind, pattern in reversed([*KINDS.items()][:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(mention: Column, kind: Column, surnames: Column | None = None, given: Column | None = None) -> Column:
    """(type, canon, raw, gender) for each part of a mention; parts of type "" stay. Equal (type, canon) are one entity.

    Numbers are known by their digits, e-mail addresses in lower case, persons by each name: what comes last is the
    surname, so "Mr. Ada Holm" and "Mrs. Holm" share it; particles stay, an initial is an entity of its own. Names without a title, and one name behind a title, are what the
    document's titled persons make them: ``surnames`` or ``given`` names, or either by their place if they are both.
    """

    def part(kind: Column, canon: Column, raw: Column, gender: Column | None = None) -> Column:
        return F.struct(kind.alias("type"), canon.alias("canon"), raw.alias("raw"), (F.lit("n") if gender is None else gender).alias("gender"))

    number = _digits(mention)
    phone = F.when((F.length(number) == 11) & number.startswith("1"), number.substr(2, 10)).when(mention.startswith("+"), F.concat(F.lit("+"), number)).otherwise(number)
    canon = F.when(kind.isin("email", "ip6"), F.lower(mention)).when(kind.isin("card", "ssn"), number).when(kind == "phone", phone).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)
    tokens = F.regexp_extract_all(mention, F.lit(rf"^(?:{CUES})(?=\s)|[ \t\n]+|\p{{Lu}}\.|['’]s(?!\S)|(?:(?!['’]s(?!\S))[^ \t\n])+"), F.lit(0))
    gender = F.when(mention.rlike(rf"^(?:{TITLES['m']})\b"), "m").when(mention.rlike(rf"^(?:{TITLES['f']})\b"), "f").otherwise("n")

    titled = mention.rlike(rf"^(?:{OPENING})")
    several = F.size(F.filter(tokens, lambda t: ~t.rlike(r"^\s|^['’]s$"))) > 2

    def name(t: Column, i: Column) -> Column:
        end = F.size(tokens) - F.when(F.element_at(tokens, -1).rlike("^['’]s$"), 2).otherwise(1)
        is_surname = i == end
        if surnames is not None:
            known = F.when(is_surname, F.array_contains(surnames, F.lower(t))).otherwise(~F.array_contains(given, F.lower(t)))
            is_surname = F.when(titled & several, is_surname).otherwise(known)
        stays = (titled & (i == 0)) | t.rlike(r"^\s|^['’]s$") | ((i < end) & F.lower(t).rlike(f"^(?:{PARTICLES})$"))
        role = F.when(stays, "").when(t.rlike(r"^\p{Lu}\.$"), "initial").otherwise(F.concat(F.when(is_surname, "surname:").otherwise("given:"), _script(t)))
        return part(role, F.lower(t), t, F.when(role.startswith("given"), gender).otherwise("n"))

    return F.when(kind == "person", F.transform(tokens, name)).otherwise(F.array(part(kind, canon, mention)))


def _mentions(text: Column) -> Column:
    """(list, bare, surnames, given) of a text: its mentions, and the pattern of the names of titled persons, null without any.

    With titled persons the list also has their names where they stand without a title, as they were written, in capitals
    or with capitals at the start only. A name that is also a common word (one of COMMON or CALENDAR, or in lower case
    elsewhere in the text) is one beside another name, or, but for those of CALENDAR, inside of a sentence without an article before it.
    """

    def of(found: Column) -> Column:
        persons = F.filter(found, lambda m: m.rlike(rf"^(?:{PERSON})$"))
        each = F.transform(persons, lambda m: F.filter(_parts(m, F.lit("person")), lambda p: ~p["type"].isin("", "initial")))
        return let(each, lambda each: let(F.flatten(each), lambda names: let(bare(names), lambda b: let(whole(each, "given"), lambda given: F.struct(
            F.when(b.isNull(), found).otherwise(F.regexp_extract_all(text, F.concat(F.lit(f"{ANY}|"), b), F.lit(0))).alias("list"), b.alias("bare"),
            F.array_union(whole(each, "surname"), F.array_except(canon(F.flatten(F.filter(each, lambda p: F.size(p) == 1))), given)).alias("surnames"), given.alias("given"),
        )))))

    def canon(names: Column) -> Column:
        return F.array_distinct(F.transform(names, lambda p: p["canon"]))

    def whole(each: Column, role: str) -> Column:
        """Names of that role of the persons that are named by two names or more."""
        return canon(F.filter(F.flatten(F.filter(each, lambda p: F.size(p) > 1)), lambda p: p["type"].startswith(role)))

    def one(names: Column) -> Column:
        """A pattern of one of the names as a whole word; of none of them without any."""
        written = F.flatten(F.transform(names, lambda p: F.array(p["raw"], F.upper(p["raw"]), F.initcap(p["raw"]))))
        # Longer names first, so that none is cut at a shorter one.
        longest = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(written), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))), lambda x: x["x"])
        return F.when(F.size(names) > 0, F.concat(F.lit("(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}_])"))).otherwise("(?!)")

    def bare(names: Column) -> Column:
        # Parts of addresses in lower case make no word common.
        low = F.concat(F.lit(r"(?<![\p{L}\p{N}_.@/-])(?:"), F.array_join(canon(names), "|"), F.lit(r")(?![\p{L}\p{N}_@/-]|\.\p{L})"))
        words = F.array_union(F.regexp_extract_all(text, low, F.lit(0)), F.array(*[F.lit(w) for w in COMMON]))
        is_date = lambda p: p["canon"].isin(*CALENDAR)

        def pattern(words: Column) -> Column:
            is_word = lambda p: F.array_contains(words, p["canon"])
            any_, sure = one(names), one(F.filter(names, lambda p: ~is_word(p) & ~is_date(p)))
            inside = one(F.filter(names, lambda p: is_word(p) & ~is_date(p)))
            more = F.concat(F.lit(r"(?:[ \t]+"), any_, F.lit(")"))
            return F.concat(
                F.lit(r"(?<![\p{L}\p{N}_])(?:"), sure, more, F.lit("{0,2}|"), any_, more, F.lit("{1,2}|"),
                F.lit(rf"(?<=[\p{{Ll}}\p{{N}},;][ \t])(?<!(?<![\p{{L}}])(?:{ARTICLES})[ \t])"), inside, F.lit(")"),
            )

        return F.when(F.size(names) > 0, let(words, pattern))

    return let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), of)


def _byte(seed: Column, i: Column | int) -> Column:
    at = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(seed, (at % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.split(x, "(?!^)(?!$)")


def _keyed(message: Column, secret: str) -> Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def _mod97(x: Column) -> Column:
    """The remainder by 97 of a string whose letters stand for 10 to 35."""

    def add(a: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (a * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(_chars(x), F.lit(0), add)


def _hex_alike(x: Column, seed: Column) -> Column:
    """Other hexadecimal digits, in lower case; a first digit isn't 0."""
    digit = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(_byte(seed, i) % 15 + 1))).otherwise(c)
    return F.array_join(F.transform(_chars(x), digit), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    backwards = F.reverse(_chars(digits))

    def worth(c: Column, i: Column) -> Column:
        once = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = once * 2
        return F.when(i % 2 == 0, once).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(backwards, worth), F.lit(0), lambda a, b: a + b) % 10


def _alike(x: Column, seed: Column, first: str = "") -> Column:
    """Other letters for ASCII letters, other digits for digits, everything else as it is. ``first``: digits the first may be."""

    def other(c: Column, i: Column) -> Column:
        b = _byte(seed, i)
        digit = F.substring(F.lit("0123456789"), b % 10 + 1, F.lit(1))
        if first:
            digit = F.when(i == 0, F.substring(F.lit(first), b % len(first) + 1, F.lit(1))).otherwise(digit)
        small, large = F.chr(b % 26 + 97), F.chr(b % 26 + 65)
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), large).otherwise(c)

    return F.array_join(F.transform(_chars(x), other), "")


def _pick(options: list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), b % len(options) + 1)


def _surrogate(kind: Column, canon: Column, attempt: Column, secret: str) -> Column:
    """The canonical surrogate: a function of the secret, the entity and the attempt only."""
    seed = _keyed(F.concat_ws("|", kind, canon, attempt.cast("string")), secret)
    more = F.when(attempt > 3, F.substring(F.translate(seed, "0123456789", "ghijklmnop"), F.lit(1), attempt - 3)).otherwise("")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(_alike(local, seed), more, F.lit("@"), _alike(domain.substr(F.lit(1), F.length(domain) - F.length(top)), F.reverse(seed)), top)
    ip = F.concat_ws(".", *[(_byte(seed, i) % 254 + 1).cast("string") for i in range(4)])
    body = F.concat(F.substring(canon, 1, 1), _alike(canon.substr(F.lit(2), F.length(canon) - 2), seed))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    wrong = (_byte(seed, 63) % 9 + 1 + check) % 10
    card = F.concat(body, F.when(_luhn(canon) == 0, check).otherwise(wrong).cast("string"))
    land, account = F.substring(canon, 1, 2), _alike(canon.substr(F.lit(5), F.length(canon)), seed)
    digits = F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(canon.substr(F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    iban = F.concat(land, F.when(valid, digits).otherwise(_alike(F.substring(canon, 3, 2), F.reverse(seed))), account)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", _hex_alike(canon, seed)).when(kind == "card", card).when(kind == "iban", iban)
    # A number's country code, of two digits for the most part, or its leading 0 stays.
    stays = F.when(canon.startswith("+"), 3).when((kind == "phone") & canon.startswith("0"), 1).otherwise(0)
    out = out.when(kind.isin("phone", "ssn"), F.concat(canon.substr(F.lit(1), stays), _alike(canon.substr(stays + 1, F.length(canon)), seed, "23456789")))
    for script, syllables in SYLLABLES.items():
        stem = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + F.floor(attempt / 3).cast("int")), lambda i: _pick(syllables, _byte(seed, i))), "")
        for role, endings in ENDINGS[script].items():
            out = out.when(kind == (f"surname:{script}" if role == "surname" else f"given-{role}:{script}"), F.concat(stem, _pick(endings, _byte(seed, 0))))
    return out


def _initial(raw: Column, secret: str) -> Column:
    """Another letter of the same alphabet: alphabets are turned by a keyed number of places, so no two initials become one."""
    turn = int.from_bytes(hmac.digest(secret.encode(), b"initial", "sha512")[:8], "big")
    alphabets = [[chr(c) for c in range(a, b + 1) if chr(c).isalpha()] for a, b in ((0x41, 0x5A), (0xC0, 0xDE), (0x391, 0x3A9), (0x410, 0x42F))]
    turned = ["".join(a[n:] + a[:n]) for a in alphabets for n in [turn % (len(a) - 1) + 1]]
    return F.translate(raw, "".join("".join(a) for a in alphabets), "".join(turned))


def _render(kind: Column, raw: Column, surrogate: Column, secret: str) -> Column:
    """The surrogate written as the mention was: its separators, extra leading digits and capitals."""
    digits, own = _digits(raw), _digits(surrogate)
    filled = F.concat(digits.substr(F.lit(1), F.length(digits) - F.length(own)), own)
    place = F.transform(_chars(raw), lambda c: c.rlike("[0-9]").cast("int"))

    def put(c: Column, i: Column) -> Column:
        n = F.aggregate(F.slice(place, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b)
        return F.when(c.rlike("[0-9]"), F.substring(filled, n, F.lit(1))).otherwise(c)

    def spaced(c: Column, i: Column) -> Column:
        solid = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(surrogate, solid, F.lit(1)))

    number = F.array_join(F.transform(_chars(raw), put), "")
    large = lambda c, i: F.when(F.substring(raw, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)
    cased = F.array_join(F.transform(_chars(surrogate), large), "")
    capital = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (
        F.when(kind == "", raw).when(kind == "initial", _initial(raw, secret)).when(kind.isin("card", "phone", "ssn"), number).when(kind == "iban", F.array_join(F.transform(_chars(raw), spaced), ""))
        .when(kind.isin("email", "ip6"), cased).when(kind == "ip", surrogate).otherwise(capital)
    )


def assign_surrogates(scratch: Scratch, entities: DataFrame, secret: str, attempts: int = 64) -> DataFrame:
    """(type, canon, surrogate) for each of the distinct ``entities``: no two of a type share a surrogate, and no surrogate
    is an entity of its type. Each round checks all, and those that collide, but for the least, try again; an entity that
    was settled can't be taken from. Raises when ``attempts`` rounds aren't enough: the format holds too few values.
    """
    known = scratch.keep("entities", entities)
    settled = None
    asking = known.withColumn("attempt", F.lit(0))
    for round_ in range(attempts):
        tried = asking.withColumn("surrogate", _surrogate(F.col("type"), F.col("canon"), F.col("attempt"), secret))
        real = known.select("type", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        tried = tried.join(real, ["type", "surrogate"], "left")
        if settled is not None:
            tried = tried.join(settled.select("type", "surrogate", F.lit(True).alias("taken")), ["type", "surrogate"], "left")
        else:
            tried = tried.withColumn("taken", F.lit(None).cast("boolean"))
        tried = scratch.keep(f"tried{round_}", tried)
        free = tried.where("real IS NULL AND taken IS NULL")
        first = free.groupBy("type", "surrogate").agg(F.min("canon").alias("canon"))
        now = first if settled is None else settled.unionByName(first)
        settled = scratch.keep(f"settled{round_}", now.select("type", "canon", "surrogate"))
        asking = tried.select("type", "canon", (F.col("attempt") + 1).alias("attempt")).join(settled, ["type", "canon"], "left_anti")
        for old in (f"tried{round_ - 1}", f"settled{round_ - 1}") if round_ else ():
            scratch.drop(old)
        if asking.isEmpty():
            return settled
    raise ValueError(f"no distinct surrogates for all entities after {attempts} attempts")


def replace_entities(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_<kind>`` for each of KINDS.

    A surrogate depends on ``secret`` and the entity, so an entity has the same one in every document and every run on the
    same documents; it keeps kind, length and layout, capitals, an IBAN's country, a card's brand, whether their check digits
    are right, top-level domain, script, and the gender that the titles before a given name tell, if they tell one. Seeds are
    HMACs under ``secret``. ``assign_surrogates`` keeps distinct
    entities distinct. Persons are known by a title (TITLES) or where they name themselves (CUES), with initials and particles; their names are
    also replaced elsewhere in the same document, those that are common words only where ``_mentions`` takes them for names. Persons that
    have neither anywhere in a document stay. A line may end behind a title's full stop, a cue, an initial or a particle, not between two names.

    One pass over all texts finds mentions and writes them; entities are distinct by map-side aggregation; mentions meet their surrogates
    by a join that the engine can split at a hot entity. Only documents with mentions are shuffled, to meet their list of
    replacements; a text is taken apart at its mentions and put together with the replacements between.

    Null texts stay null, empty ones empty. Very long texts are searched whole. Null or repeated keys are told apart by text.
    An empty table gives an empty result. Other columns are passed on, but for columns named as the counts, which are
    replaced; names that begin with __tm_ are reserved.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = docs.select(F.col(key).alias("__tm_key"), row_hash(key, text).alias("__tm_row"), _mentions(F.col(text)).alias("m"))
    found = found.select("__tm_key", "__tm_row", "m.bare", "m.surnames", "m.given", F.posexplode("m.list").alias("pos", "mention"))
    found = found.withColumn("kind", _kind(F.col("mention"))).withColumn("parts", _parts(F.col("mention"), F.col("kind"), F.col("surnames"), F.col("given")))
    found = scratch.keep("mentions", found.select("__tm_key", "__tm_row", "bare", "pos", "kind", F.posexplode("parts").alias("no", "part")).select("__tm_key", "__tm_row", "bare", "pos", "kind", "no", "part.*"))
    told = found.where("type NOT IN ('', 'initial')").groupBy("type", "canon").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    settled = F.when(F.col("type").startswith("given:"), F.concat(F.lit("given-"), gender, F.substring("type", 6, 100))).otherwise(F.col("type"))
    entities = assign_surrogates(scratch, told.select(settled.alias("type"), "canon"), secret)
    entities = entities.withColumn("type", F.regexp_replace("type", "^given-.", "given"))

    met = found.join(entities, ["type", "canon"], "left").withColumn("new", _render(F.col("type"), F.col("raw"), F.col("surrogate"), secret))
    each = met.groupBy("__tm_key", "__tm_row").agg(F.array_sort(F.collect_set(F.struct("pos", "no", "kind", "new"))).alias("__tm_new"), F.first("bare").alias("__tm_bare"))
    each = each.select(F.col("__tm_key").alias("__tm_k"), F.col("__tm_row").alias("__tm_r"), "__tm_new", "__tm_bare")

    # Only documents with mentions, and few others, are shuffled and taken apart.
    may, same = split_listed(docs.withColumn("__tm_row", row_hash(key, text)), F.col("__tm_row"), found.select("__tm_row"), "__tm_row")
    met = may.join(each, F.col(key).eqNullSafe(F.col("__tm_k")) & (F.col("__tm_row") == F.col("__tm_r")), "left")
    # Parts of one mention stand together; what lies between mentions follows the last part of each.
    ends = lambda x, i: ~F.coalesce(F.get("__tm_new", i + 1)["pos"] == x["pos"], F.lit(False))
    piece = lambda between: lambda x, i: F.concat(x["new"], F.when(ends(x, i), F.get(between, x["pos"] + 1)).otherwise(""))
    parts = F.when(F.col("__tm_bare").isNull(), F.split(text, ANY, -1)).otherwise(F.split(F.col(text), F.concat(F.lit(f"{ANY}|"), F.col("__tm_bare")), F.lit(-1)))
    joined = let(parts, lambda between: F.concat(F.get(between, F.lit(0)), F.array_join(F.transform("__tm_new", piece(between)), "")))
    new = F.when(F.col("__tm_new").isNull(), F.col(text)).otherwise(joined)
    count = lambda k: F.coalesce(F.size(F.filter("__tm_new", lambda x: (x["kind"] == k) & (x["no"] == 0))), F.lit(0)).cast("long").alias(f"n_{k}")
    others = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    changed = met.select(*[new.alias(c) if c == text else F.col(c) for c in others], *[count(k) for k in KINDS])
    return changed.unionByName(same.select(*others, *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS]))
