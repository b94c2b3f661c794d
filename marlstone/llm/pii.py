"""PII surrogates: every detected entity gets a keyed replacement of its own kind, format, script and gender.

Detection is one pattern over the whole text. A person is known by name, not by spelling: titles with or without dots,
one or several, a title with the family name of the one full name of a text that it fits, the bare full name, and any of
these in capitals are mentions of the same person, who has one family name throughout; the given name follows the gender
that the mention's titles tell, or else another mention's. A phone or card number is known by its digits, however they are
grouped. The replacement of an entity is a function of (key, kind, entity, attempt), so the same entity gets the
same surrogate in every document and no table of entities has to travel back to the texts.

Distinct entities must keep distinct surrogates (persons: distinct family names): the surrogates of all distinct
entities are compared, also with all entities themselves, and those that collide move on to their next attempt until
none is left. From attempt ``GROW_FROM`` on surrogates grow, so that room is never used up: longer names and numbers, a
wider private range and then IPv6 for addresses. Only those exceptions are joined back to the documents. Only DataFrame
functions run.

Defined results: a null text stays null and has no entities; an empty text stays empty; repeated rows get equal
results; other columns pass through (those named n_email and so on are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.columns import let, others, unused, whole
from marlstone.llm.store import cut

KEY = "surrogate-key-1"
#: The first attempts keep an entity's shape; each further one is a character longer.
GROW_FROM = 4
#: Up to so many entities that have moved on, and bytes of their names, go to the texts by broadcast, in so many maps.
BROADCAST_MOVED, BROADCAST_BYTES, SLOTS = 100_000, 8 << 20, 1024

#: Titles that tell a gender, and given names to put in.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL_TITLES = ("Dr", "Prof", "Mx")
FEMALE_NAMES = ("Alice", "Clara", "Diana", "Elena", "Emma", "Greta", "Helen", "Ines", "Julia", "Karin", "Laura", "Marie", "Nina", "Olga", "Rosa", "Sofia")
MALE_NAMES = ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Niels", "Oscar", "Paul")
NEUTRAL_NAMES = ("Alex", "Andrea", "Chris", "Dominique", "Jo", "Kim", "Luca", "Noel", "Pat", "Robin", "Sam", "Sascha", "Sidney", "Taylor", "Toni", "Yuri")
CYRILLIC_FEMALE = ("Алла", "Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Тамара", "Ульяна", "Юлия")
CYRILLIC_MALE = ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Тимур")
GREEK_FEMALE = ("Αγγελική", "Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Όλγα", "Ρένα", "Σοφία", "Χαρά")
GREEK_MALE = ("Αλέξης", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λάμπρος", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης", "Χρήστος")
SYLLABLES = ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "zan")
CYRILLIC_SYLLABLES = ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "жу", "зан")
GREEK_SYLLABLES = ("βα", "δε", "φι", "γο", "χυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "θω", "ζα", "ξε")

TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES)
#: One title or several: "Frau Prof. Dr. ".
TITLED = rf"(?:(?:{TITLES})\.? )+"
#: A word of a name: inner capitals, hyphens and apostrophes belong to it, a possessive s does not.
_INNER = r"(?:(?:-|['’](?!s(?!\p{L})))\p{L}+)"
WORD = rf"\p{{Lu}}(?:\p{{L}}+{_INNER}*|{_INNER}+)"
#: Letters of addresses: Latin, Greek and Cyrillic.
_LETTER = "A-Za-zÀ-ɏͰ-Ͽѐ-ӿЀ-я"
#: Each pattern first looks at what lies before it, so that no place inside a word or number is tried in full.
EMAIL = rf"(?<![{_LETTER}0-9._%+-])[{_LETTER}0-9][{_LETTER}0-9._%+-]*+@[{_LETTER}0-9-]+(?:\.[{_LETTER}0-9-]+)*\.[{_LETTER}]{{2,}}"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{16}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
FIRST = "".join(sorted({x[0] for x in FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES}))
NAME = rf"(?=[{FIRST}])(?<!\p{{L}}){TITLED}{WORD}(?: {WORD})?"
ANY = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{IP}|{CARD}|{PHONE}|{SSN}|{NAME})"
#: A text without a digit, an @ and a title has no entity; this is cheap to see.
HINT = rf"[0-9@]|(?=[{FIRST}])(?<!\p{{L}})(?:{TITLES})\.? "
KINDS = ("email", "ip", "card", "phone", "ssn", "name")
#: The country's code of a phone number.
CODE = r"^(\+[0-9]{1,3})(?=[ .(-])"


def kind_of(m: Column) -> Column:
    """The kind of an entity that the pattern has matched."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
        .when(m.rlike(r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$"), "card")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _rest(m: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(m, rf"^{TITLED}", "")


def _person_of(m: Column) -> Column:
    """Who a name without titles stands for: a name in capitals is the same person's as in small letters."""
    r = _rest(m)
    return F.when(_shouted(r), F.initcap(r)).otherwise(r)


def _shouted(name: Column) -> Column:
    """Whether a name is written in capitals."""
    return ~name.rlike(r"\p{Ll}")


def _last(person: Column) -> Column:
    return F.substring_index(person, " ", -1)


def _gender(m: Column) -> Column:
    """What the titles of a match tell."""
    some = lambda titles: m.rlike(rf"^(?:(?:{TITLES})\.? )*(?:{'|'.join(titles)})\.? ")
    return F.when(some(FEMALE_TITLES), "f").when(some(MALE_TITLES), "m").otherwise("n")


def _digits(m: Column, kind: Column) -> Column:
    """What numbers have in common however they are grouped: the country's code (none for +1), then the digits."""
    code = F.regexp_extract(m, CODE, 1)
    plain = F.regexp_replace(F.substring(m, F.length(F.regexp_extract(m, CODE, 0)) + 1, F.length(m)), "[^0-9]", "")
    phone = F.when(code.isin("", "+1"), plain).otherwise(F.concat(code, F.lit(" "), plain))
    return F.when(kind == "card", F.regexp_replace(m, "[^0-9]", "")).when(kind == "phone", phone).otherwise(m)


def _regrouped(m: Column, new: Column) -> Column:
    """The digits of ``new`` in the grouping of ``m``; further ones at its end."""
    body = F.regexp_extract(m, CODE, 0)
    rest = F.substring(m, F.length(body) + 1, F.length(m))
    digits = F.regexp_replace(new, CODE + " ?", "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("n"))

    def put(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["s"], F.when(digit, F.substring(digits, a["n"], F.lit(1))).otherwise(c)).alias("s"), (a["n"] + F.when(digit, 1).otherwise(0)).alias("n"))

    return F.concat(body, F.aggregate(F.split(rest, ""), start, put, lambda a: F.concat(a["s"], F.substring(digits, a["n"], F.length(digits)))))


def _mention(m: Column, people: Column, fulls: Column) -> Column:
    """What a match stands for: (m, kind, entity, gender); of names, the entity is the person."""

    def person(r: Column) -> Column:
        fits = F.filter(fulls, lambda x: _last(x) == r)
        return F.when(r.contains(" "), r).otherwise(let(fits, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(r)))

    def gender(p: Column) -> Column:
        # its own titles first, then those of other mentions
        own = F.nullif(_gender(m), F.lit("n"))
        told = F.filter(people, lambda x: (x["gender"] != "n") & ((x["rest"] == p) | (x["rest"] == _last(p))))
        return F.coalesce(own, F.get(told, F.lit(0))["gender"], F.lit("n"))

    def named(p: Column) -> Column:
        return F.struct(m.alias("m"), F.lit("name").alias("kind"), p.alias("entity"), gender(p).alias("gender"))

    other = lambda k: F.struct(m.alias("m"), k.alias("kind"), _digits(m, k).alias("entity"), F.lit("n").alias("gender"))
    return let(kind_of(m), lambda k: F.when(k == "name", let(person(_person_of(m)), named)).otherwise(other(k)))


def mentions(text: Column) -> Column:
    """(pattern, found) of a text: the pattern that cuts it, and (m, kind, entity, gender) of each match in order.

    Full names that follow a title are looked for everywhere else in that text too.
    """

    def of(people: Column) -> Column:
        fulls = F.array_distinct(F.transform(F.filter(people, lambda x: x["rest"].contains(" ")), lambda x: x["rest"]))
        return let(fulls, lambda f: let(_pattern(f), lambda p: F.struct(
            p.alias("pattern"), F.transform(F.regexp_extract_all(whole(text), p, F.lit(0)), lambda m: _mention(m, people, f)).alias("found")
        )))

    def _pattern(f: Column) -> Column:
        either = F.flatten(F.transform(f, lambda x: F.array(x, F.upper(x))))
        names = F.concat(F.lit(ANY + r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(either, "|"), F.lit(r")(?!\p{L})"))
        return F.when(F.size(f) > 0, names).otherwise(F.lit(ANY))

    titled = F.regexp_extract_all(whole(text), F.lit(NAME), F.lit(0))
    people = F.array_distinct(F.transform(titled, lambda m: F.struct(_person_of(m).alias("rest"), _gender(m).alias("gender"))))
    return F.when(whole(text).rlike(HINT), let(people, of))


def entities(text: Column) -> Column:
    """Every mention of an entity in a text, in order, repeats included."""
    return F.coalesce(F.transform(mentions(text)["found"], lambda x: x["m"]), F.array().cast("array<string>"))


def _number(digest: Column, i: Column | int, below: int) -> Column:
    """A number under ``below`` from the i-th byte pair of a hexadecimal digest of 32 such pairs."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return (F.conv(F.substring(digest, at * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _pick(values, digest: Column, i: Column | int) -> Column:
    return F.get(F.array(*(F.lit(x) for x in values)), _number(digest, i, len(values)))


def _alike(m: Column, digest: Column) -> Column:
    """The same string with other digits for digits and other letters for letters of either case and script."""

    def one(c: Column, i: Column) -> Column:
        def within(low: int, n: int) -> Column:
            return F.substring(F.lit("".join(map(chr, range(low, low + n)))), _number(digest, i, n) + 1, F.lit(1))

        return (
            F.when(c.rlike("^[0-9]$"), within(48, 10))
            .when(c.rlike("^[a-z]$"), within(97, 26))
            .when(c.rlike("^[A-Z]$"), within(65, 26))
            .when(c.rlike(r"^\p{IsCyrillic}$"), within(0x430, 32))
            .when(c.rlike(r"^\p{IsGreek}$"), within(0x3B1, 17))
            .when(c.rlike(r"^\p{L}$"), within(97, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _grown(attempt: Column, digest: Column, low: int, n: int) -> Column:
    """The characters that a surrogate is longer by, drawn from the ``n`` from ``low`` on."""
    some = F.lit("".join(map(chr, range(low, low + n))))
    each = F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROW_FROM + 1, F.lit(1))), lambda i: F.substring(some, _number(digest, i + 18, n) + 1, F.lit(1)))
    return F.when(attempt >= GROW_FROM, F.array_join(each, "")).otherwise("")


def _luhn(digits: Column, weight_first: int) -> Column:
    """The Luhn sum of a string of digits whose first digit counts ``weight_first`` times."""
    each = F.transform(
        F.split(digits, ""),
        lambda c, i: let(
            c.cast("int") * F.when(i % 2 == 0, weight_first).otherwise(3 - weight_first),
            lambda v: F.when(v > 9, v - 9).otherwise(v),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def _card(m: Column, digest: Column) -> Column:
    """Other digits in the same grouping and from the same issuer; the check digit is right if it was right."""
    plain = F.regexp_replace(m, "[ -]", "")
    valid = _luhn(plain, 2) % 10 == 0
    body = F.concat(F.substring(plain, 1, 1), F.substring(_alike(plain, digest), 2, 14))
    check = let(body, lambda b: (10 - _luhn(b, 2) % 10) % 10)
    check = F.when(valid, check).otherwise((check + 1) % 10)
    digits = F.concat(body, check.cast("string"))
    gap = F.regexp_extract(m, "^[0-9]{4}([ -]?)", 1)
    return let(
        digits,
        lambda x: F.concat_ws("", F.substring(x, 1, 4), gap, F.substring(x, 5, 4), gap, F.substring(x, 9, 4), gap, F.substring(x, 13, 4)),
    )


def _ip(m: Column, digest: Column, attempt: Column) -> Column:
    """Four other numbers; an address of a private range stays in its range, or else in the widest one."""
    octet = lambda i: (_number(digest, i, 254) + 1).cast("string")
    private = m.startswith("10.") | m.startswith("192.168.") | m.startswith("127.")
    kept = (
        F.when(private & (attempt >= GROW_FROM), "10.")
        .when(m.startswith("10."), "10.")
        .when(m.startswith("192.168."), "192.168.")
        .when(m.startswith("127."), "127.")
        .otherwise("")
    )
    size = F.length(F.regexp_replace(kept, r"[^.]", ""))
    rest = F.slice(F.array(octet(0), octet(1), octet(2), octet(3)), 1, 4 - size)
    wide = F.concat_ws(":", F.lit("2001:db8"), *(F.substring(digest, 65 + 4 * i, 4) for i in range(6)))
    return F.when(attempt >= 4 * GROW_FROM, wide).otherwise(F.concat(kept, F.array_join(rest, ".")))


def _email(m: Column, digest: Column, attempt: Column) -> Column:
    """Another name and host of the same shape; the last label of the host stays."""
    shape = _alike(F.regexp_extract(m, r"^(.*)\.[^.]+$", 1), digest)
    return F.concat(_grown(attempt, digest, 97, 26), shape, F.regexp_extract(m, r"(\.[^.]+)$", 1))


def _person(person: Column, digest: Column, attempt: Column, gender: Column) -> Column:
    """A given name of the gender, if it is known, and a family name, both in the person's script.

    Where no title tells the gender, the endings of Cyrillic and Greek names do.
    """
    cyrillic, greek = person.rlike(r"\p{IsCyrillic}"), person.rlike(r"\p{IsGreek}")
    ends = lambda letters: person.rlike(rf"[{letters}](?: |$)")
    she = lambda letters: (gender == "f") | ((gender == "n") & ends(letters))
    given = (
        F.when(cyrillic & she("ая"), _pick(CYRILLIC_FEMALE, digest, 0))
        .when(cyrillic, _pick(CYRILLIC_MALE, digest, 0))
        .when(greek & she("αηάή"), _pick(GREEK_FEMALE, digest, 0))
        .when(greek, _pick(GREEK_MALE, digest, 0))
        .when(gender == "f", _pick(FEMALE_NAMES, digest, 0))
        .when(gender == "m", _pick(MALE_NAMES, digest, 0))
        .otherwise(_pick(NEUTRAL_NAMES, digest, 0))
    )
    places = F.sequence(F.lit(1), 5 + F.greatest(attempt - GROW_FROM + 1, F.lit(0)))
    family = lambda values: F.array_join(F.transform(places, lambda i: _pick(values, digest, i)), "")
    family = F.initcap(F.when(cyrillic, family(CYRILLIC_SYLLABLES)).when(greek, family(GREEK_SYLLABLES)).otherwise(family(SYLLABLES)))
    return F.when(person.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)


def _phone(m: Column, digest: Column, attempt: Column) -> Column:
    """Other digits in the same format; the country code stays."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])[ .-]?)", 1)
    return F.concat(code, _alike(F.substring(m, F.length(code) + 1, F.length(m)), digest), _grown(attempt, digest, 48, 10))


def surrogate(entity: Column, kind: Column, attempt: Column, key: str = KEY, gender: Column | None = None) -> Column:
    """The replacement of an entity on its so-manyth attempt; a person's family name does not depend on the gender."""
    seed = F.sha2(F.concat_ws("\x00", F.lit(key), kind, entity, attempt.cast("string")), 512)
    return let(
        seed,
        lambda d: F.when(kind == "email", _email(entity, d, attempt))
        .when(kind == "ip", _ip(entity, d, attempt))
        .when(kind == "card", _card(entity, d))
        .when(kind == "phone", _phone(entity, d, attempt))
        .when(kind == "ssn", F.concat(_alike(entity, d), _grown(attempt, d, 48, 10)))
        .otherwise(_person(entity, d, attempt, F.lit("n") if gender is None else gender)),
    )


def exceptions(docs: DataFrame, key: str = KEY) -> DataFrame | None:
    """(entity, kind, attempt) of the entities whose first surrogate is taken; None if there are none.

    Entities are made distinct map-side before they are shuffled. A surrogate that several entities share stays with
    the smallest of them; one that is itself an entity of the corpus stays with none. Each round's losers grow, so the
    rounds come to an end.
    """
    known = docs.select(F.explode(mentions(F.col("text"))["found"]).alias("x")).select("x.entity", "x.kind").distinct()
    known = cut(known)
    told = lambda x: F.when(F.col("kind") == "name", _last(x)).otherwise(x)
    own = known.select(told(F.col("entity")).alias("s"), F.struct(F.lit(0).alias("own"), "entity", "kind").alias("by"))
    moved = None
    while True:
        now = known if moved is None else known.join(moved, ["entity", "kind"], "left")
        tried = F.lit(0) if moved is None else F.coalesce("attempt", F.lit(0))
        now = now.select("entity", "kind", tried.alias("attempt"))
        now = now.withColumn("s", told(surrogate(F.col("entity"), F.col("kind"), F.col("attempt"), key)))
        # an entity stands for itself as a taken surrogate, before all others
        taken = now.select("s", F.struct(F.lit(1).alias("own"), "entity", "kind").alias("by")).unionByName(own)
        first = taken.groupBy("s").agg(F.min("by").alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = now.join(first, "s").where(
            (F.col("first.own") == 0) | (F.col("first.entity") != F.col("entity")) | (F.col("first.kind") != F.col("kind"))
        )
        lost = cut(lost.select("entity", "kind", (F.col("attempt") + 1).alias("attempt")))
        if lost.isEmpty():
            return moved
        moved = lost if moved is None else cut(moved.join(lost, ["entity", "kind"], "left_anti").unionByName(lost))


def replace(docs: DataFrame, key: str = KEY, moved: DataFrame | None = None) -> DataFrame:
    """``docs`` with every entity replaced, and n_<kind> for each kind. ``moved``: what ``exceptions`` has returned."""
    counts = [f"n_{k}" for k in KINDS]
    rest = others(docs, *counts)
    e, d, n, t, odd = unused(docs, "_e", "_d", "_n", "_t", "_tries")
    told = lambda x: F.concat_ws("\x00", x["kind"], x["entity"])
    none = F.create_map().cast("map<string,int>")
    tries = lambda x: none
    if moved is not None:
        names = moved.select(told({k: F.col(k) for k in ("kind", "entity")}).alias("told"), "attempt")
        size = names.agg(F.count("*").alias("n"), F.sum(F.octet_length("told")).alias("bytes")).first()
        if size["n"] <= BROADCAST_MOVED and (size["bytes"] or 0) <= BROADCAST_BYTES:
            # one row of small maps by hash: entities are looked up where they are found, texts are not shuffled
            slot = lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")
            held = names.groupBy(slot(F.col("told")).alias("k")).agg(F.collect_list(F.struct("told", "attempt")).alias("m"))
            all_slots = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("k")).join(held, "k", "left")
            one = all_slots.agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("slots"))
            one = one.select(F.transform("slots", lambda x: F.map_from_entries(F.coalesce(x["m"], F.array().cast("array<struct<told:string,attempt:int>>")))).alias(odd))
            docs = docs.crossJoin(F.broadcast(one))
            tries = lambda x: F.get(F.col(odd), slot(told(x)))
        else:
            # rows are known by id, also without one, and text
            keys = {d: F.coalesce(F.col("doc_id"), F.lit(0)), n: F.col("doc_id").isNull(), t: F.xxhash64("text")}
            docs = docs.withColumns(keys)
            asked = docs.select(*keys, F.explode(F.array_distinct(F.transform(mentions(F.col("text"))["found"], told))).alias("told"))
            asked = asked.join(names, "told").dropDuplicates([*keys, "told"])
            asked = asked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("told", "attempt"))).alias(odd))
            docs = docs.join(asked, list(keys), "left")
            tries = lambda x: F.coalesce(F.col(odd), none)

    def put(x: Column, s: Column) -> Column:
        """A mention's own titles, as many names as it had and their case; numbers in its grouping; or the surrogate itself."""
        title = F.regexp_extract(x["m"], rf"^({TITLED})", 1)
        own = _rest(x["m"])
        name = F.when(own.contains(" "), s).otherwise(_last(s))
        name = F.concat(title, F.when(_shouted(own), F.upper(name)).otherwise(name))
        return F.when(x["kind"] == "name", name).when(x["kind"].isin("card", "phone"), _regrouped(x["m"], s)).otherwise(s)

    def one(x: Column) -> Column:
        s = surrogate(x["entity"], x["kind"], F.coalesce(F.try_element_at(tries(x), told(x)), F.lit(0)), key, x["gender"])
        return let(s, lambda v: F.struct(x["kind"].alias("k"), put(x, v).alias("s")))

    made = let(mentions(F.col("text")), lambda x: F.struct(x["pattern"].alias("p"), F.transform(x["found"], one).alias("x")))
    found = docs.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.array(made)).alias(e))
    # pieces between entities and surrogates alternate; the pattern never matches an empty string
    woven = F.zip_with(
        F.split(F.col("text"), F.col(e)["p"], -1),
        F.transform(F.col(e)["x"], lambda x: x["s"]),
        lambda piece, s: F.concat(piece, F.coalesce(s, F.lit(""))),
    )
    text = F.when(F.size(F.col(e)["x"]) > 0, F.array_join(woven, "")).otherwise(F.col("text"))
    count = lambda kind: F.coalesce(F.size(F.filter(F.col(e)["x"], lambda x: x["k"] == kind)), F.lit(0)).cast("long")
    return found.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rest),
        *(count(k).alias(f"n_{k}") for k in KINDS),
    )


def anonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Check for collisions, then replace."""
    return replace(docs, key, exceptions(docs, key))


def digest(docs: DataFrame) -> DataFrame:
    """The replaced texts and the counts of each kind."""
    return anonymise(docs.select("doc_id", "text"))
