"""Personal data replaced by surrogates of the same kind.

Detected are e-mail addresses, telephone numbers, payment card, bank and social security numbers, IPv4 addresses, long
hexadecimal secrets, and names after a title. Each distinct entity gets one surrogate, drawn from a keyed hash
of its normal form, so that all its mentions in all documents change alike (coreference), whatever their
punctuation or case. Surrogates keep what the mention shows: length, punctuation and case; a card's
check digit; octets in range; the case of hexadecimal digits; a name's script and, by its titles, its gender. Family names
are entities of their own, so a family name after a title agrees with the full one; a given name has one surrogate under all titles.
Names are only found directly after a title in title case, two words at most: further words, names without a title and names or titles in
upper case stay as they are.

*Collision checks.* No two entities of a kind share a surrogate and none is itself an entity of that kind that occurs in the
texts: what collides is drawn again with the next attempt number, entities settled earlier keep theirs. Mailboxes and names grow
longer with the attempts, so there are always enough of them. Should the digits of another kind's format have hardly more
values than there are entities, what is left after ``ATTEMPTS`` rounds shares values.

Texts without an entity, null and empty ones are left as they are. Texts and runs of any length take time in proportion
and no stack: a domain of thousands of labels is one address. Every row, also a repeated one, stays, with all its columns;
rows may have any doc_id, null too. Only texts with entities are written, shuffled and rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm.common import fields, let, text_of, written

KEY = "surrogates-1"  # callers give their own secret
ATTEMPTS = 32
SAME_LENGTH = 8  # attempts after which mailboxes get longer, as a domain has few short ones

# Forms of the entities, tried in this order at each place. What repeats without a bound is possessive, or a
# single character class, and starts only where a run of its characters does: no recursion, and time linear in the text.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "n": ("Dr", "Prof"),
}
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
FORMS = {
    "email": r"(?:\G|(?<![\p{L}\p{N}_.+-]))[\p{L}\p{N}_.+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}(?: ?\d{4}){1,5}(?: ?\d{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|(?<![\p{L}\p{N}-])\d{3}-\d{3}-\d{4})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: What every entity holds: a quick look before the patterns.
HINT = rf"[0-9@]|[a-fA-F]{{32}}|(?:{_TITLE})\.? \p{{Lu}}"
# Syllables and gender endings that surrogate names are built from, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ra re sa se ta te".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ра ре са се та те".split(),
    "greek": "βα βε βι βο δα δε δι δο φα φε γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε ρα ρε σα σε τα τε".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "л"}, "greek": {"m": "ν", "f": "να", "n": "λ"}}


def _whole(x: Column, form: str) -> Column:
    return x.rlike(f"^(?:{FORMS[form]})$")


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLE})", 1)
    return F.when(title.isin(*_TITLES["m"]), "m").when(title.isin(*_TITLES["f"]), "f").otherwise("n")


def parts_of(m: Column) -> Column:
    """The entities of a mention: array of (kind, norm, mention part)."""
    part = lambda kind, norm, own: fields(kind=F.lit(kind) if isinstance(kind, str) else kind, norm=norm, own=own)
    digits = F.regexp_replace(m, r"[^0-9]", "")
    names = F.split(F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", ""), " ")

    def named(n: Column) -> Column:
        family = F.element_at(n, -1)
        one = part(F.concat(F.lit("family-"), _script(family)), F.lower(family), family)
        given = F.get(n, F.lit(0))
        both = part(F.concat(F.lit("given-"), _script(given), F.lit("-"), _gender(m)), F.lower(given), given)
        return F.when(F.size(n) > 1, F.array(both, one)).otherwise(F.array(one))

    return (
        F.when(m.contains("@"), F.array(part("email", F.lower(m), m)))
        .when(m.rlike("^[0-9a-fA-F]{32,}$"), F.array(part("secret", F.lower(m), m)))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.array(part("iban", F.regexp_replace(m, " ", ""), m)))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.array(part("ssn", digits, m)))
        .when(_whole(m, "ip"), F.array(part("ip", m, m)))
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.array(part("card", digits, m)))
        .when(m.rlike(r"\d"), F.array(part("phone", digits, m)))
        .otherwise(let(names, named))
    )


def _bytes(key: str, kind: Column, norm: Column, attempt: Column, n: int = 4) -> Column:
    """Keyed pseudo-random hexadecimal digits of an entity."""
    one = lambda k: F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"), F.lit(str(k))), 256)
    return F.concat(*[one(k) for k in range(n)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, value: Column) -> Column:
    return F.substr(F.lit(alphabet), value % len(alphabet) + 1, F.lit(1))


def _alike(x: Column, stream: Column) -> Column:
    """Each digit or Latin letter becomes another of its sort; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(c.rlike("[0-9]"), _letter("0123456789", b))
            .when(c.rlike("[a-z]"), _letter("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.rlike("[A-Z]"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"\p{L}"), _letter("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(x, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """Sum of the card check over all digits; a valid number's is divisible by 10."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    values = F.transform(F.reverse(F.split(digits, "")), one)
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _card(norm: Column, stream: Column) -> Column:
    def fixed(s: Column) -> Column:
        head = F.substr(s, F.lit(1), F.length(s) - 1)
        check = (10 - _check_sum(F.concat(head, F.lit("0"))) % 10) % 10
        return F.when(_check_sum(norm) % 10 == 0, F.concat(head, check.cast("string"))).otherwise(s)

    return let(_alike(norm, stream), fixed)


def _spelled(script: str, end: Column, stream: Column, attempt: Column) -> Column:
    """A name of syllables; later attempts are longer, so there are always enough."""
    syllables = F.array(*map(F.lit, SYLLABLES[script]))
    picks = F.transform(F.sequence(F.lit(0), attempt + 3), lambda i: F.get(syllables, _byte(stream, i) % len(SYLLABLES[script])))
    return F.concat(F.array_join(picks, ""), end)


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, itself in normal form."""

    def drawn(s: Column) -> Column:
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(s, i) % 254 + 1).cast("string")), ".")
        hexadecimal = F.substr(F.repeat(s, F.ceil(F.length(norm) / F.length(s)).cast("int")), F.lit(1), F.length(norm))
        domain = F.regexp_extract(norm, "@(.*)$", 1)
        own = _bytes(key, F.lit("domain"), domain, F.lit(0), 1)
        longer = F.repeat(F.lit("x"), F.greatest(attempt - SAME_LENGTH + 1, F.lit(0)))
        local = _alike(F.concat(F.regexp_extract(norm, "^(.*)@", 1), longer), s)
        email = F.concat(local, F.lit("@"), F.substr(F.translate(own, "0123456789", "ghijklmnop"), F.lit(1), F.lit(10)), F.lit(".example"))
        out = F.when(kind == "email", email).when(kind == "secret", hexadecimal).when(kind == "ip", octets).when(kind == "card", _card(norm, s))
        for script in SYLLABLES:
            out = out.when(kind == f"family-{script}", _spelled(script, F.lit(""), s, attempt))
            for gender, end in ENDINGS[script].items():
                out = out.when(kind == f"given-{script}-{gender}", _spelled(script, F.lit(end), s, attempt))
        return out.otherwise(_alike(norm, s))

    return let(_bytes(key, kind, norm, attempt), drawn)


def in_form(kind: Column, own: Column, drawn: Column) -> Column:
    """The surrogate spelled like the mention: its punctuation around the characters, and its case."""
    chars = F.split(own, "")
    before = lambda i: F.length(F.regexp_replace(F.substr(own, F.lit(1), i), "[^A-Za-z0-9]", ""))
    spaced = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(drawn, before(i) + 1, F.lit(1))).otherwise(c)), ""
    )
    upper = (own == F.upper(own)) & (own != F.lower(own))
    cased = F.when(upper, F.upper(drawn)).when(F.substr(own, F.lit(1), F.lit(1)) == F.lower(F.substr(own, F.lit(1), F.lit(1))), drawn)
    return (
        F.when(kind.isin("ssn", "card", "phone", "iban"), spaced)
        .when(kind == "ip", drawn)
        .when(kind.isin("email", "secret"), F.when(upper, F.upper(drawn)).otherwise(drawn))
        .otherwise(cased.otherwise(F.initcap(drawn)))
    )


def surrogates(entities: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, norm, drawn) for distinct (kind, norm), without collisions."""
    named = written(entities.select("kind", "norm").distinct(), "entities")
    drawn = lambda df: df.withColumn("drawn", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    now = written(drawn(named.withColumn("attempt", F.lit(0))), "surrogates")
    real = named.select("kind", F.col("norm").alias("drawn"), F.lit(True).alias("real"))
    for _ in range(attempts):
        owner = now.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "norm")).alias("owner"))
        marked = now.join(owner, ["kind", "drawn"]).join(real, ["kind", "drawn"], "left")
        bad = (F.col("owner.norm") != F.col("norm")) | F.col("real").isNotNull()
        marked = written(marked.select("kind", "norm", "attempt", "drawn", bad.alias("bad")), "surrogates")
        again = marked.where("bad")
        if again.isEmpty():
            break
        again = drawn(again.select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        now = written(marked.where("NOT bad").select("kind", "norm", "attempt", "drawn").unionByName(again), "surrogates")
    return now.select("kind", "norm", "drawn")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of ``docs`` with entities in ``text`` replaced, plus ``__n_entities``."""
    text = text_of()
    maybe = text.rlike(HINT)
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    some = docs.withColumns({"__row": F.monotonically_increasing_id(), "__found": found}).where(F.size("__found") > 0)
    some = written(some, "texts-with-entities")
    none = docs.where(~(maybe & text.rlike(ANY))).withColumn("__n_entities", F.lit(0).cast("long"))

    mentions = some.select("__row", F.explode(F.array_distinct("__found")).alias("m"))
    mentions = mentions.select("__row", "m", F.posexplode(parts_of(F.col("m"))).alias("i", "part")).select("__row", "m", "i", "part.*")
    # One ending for a given name, whatever titles it has: of its genders the first of f, m and n (none told).
    without = F.regexp_replace("kind", "^(given-[a-z]+)-[fmn]$", "$1")
    gender = F.regexp_extract("kind", "^given-[a-z]+(-[fmn])$", 1)
    entities = mentions.select(without.alias("kind"), "norm", gender.alias("gender")).groupBy("kind", "norm").agg(F.min("gender").alias("gender"))
    drawn = surrogates(entities.select(F.concat("kind", "gender").alias("kind"), "norm"), key).withColumn("kind", without)
    mentions = mentions.withColumn("kind", without)
    known = mentions.join(drawn, ["kind", "norm"]).select("__row", "m", "i", "own", in_form(F.col("kind"), F.col("own"), F.col("drawn")).alias("new"))
    by_row = known.groupBy("__row").agg(F.collect_list(F.struct("m", "i", "own", "new")).alias("__known"))

    def new_mention(m: Column) -> Column:
        """The mention with its parts replaced; names have two, the family name is the last."""
        own = F.sort_array(F.filter("__known", lambda k: k["m"] == m))
        first, last = F.get(own, F.lit(0)), F.element_at(own, -1)
        names = F.concat(
            F.substr(m, F.lit(1), F.length(m) - F.length(first["own"]) - F.length(last["own"]) - 1), first["new"], F.lit(" "), last["new"]
        )
        one = F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(last["own"])), last["new"])
        return F.when(F.size(own) > 1, names).otherwise(one)

    def joined(x: Column) -> Column:
        pieces = F.split("text", ANY, -1)
        return F.array_join(F.concat(F.array(F.get(pieces, F.lit(0))), F.flatten(F.zip_with(x, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, p: F.array(m, p)))), "")

    changed = some.join(by_row, "__row")
    changed = changed.withColumn("text", let(F.transform("__found", new_mention), joined))
    changed = changed.withColumn("__n_entities", F.size("__found").cast("long")).select(*docs.columns, "__n_entities")
    return none.unionByName(changed)
