"""Surrogates for private data. DataFrame operations only.

Detected entities: e-mail addresses, telephone numbers, IPv4 addresses, card and account numbers, social security
numbers, secret keys, and names: after a form of address, and then anywhere in the same text, with or without the given
name.

Entities are normalised: letter case, separators and forms of address make no difference, and a name is its given and its
family name. Each distinct normalised entity gets one surrogate in all documents, so coreference is kept: Mrs. Anna Smith,
Mrs Smith and Anna Smith share their surrogate's family name. Surrogates come from a keyed hash of the normalised entity,
one for each draw, and take its type and form: digits for digits, letters of the same script for letters, the domain's
shape and ending, the country code, a valid check digit where it was valid, a given name of the same gender and script.
They are put back into the entity's own format. Candidates are checked: one that is an entity of the corpus, or that
another entity has, is drawn again until all are distinct; later draws have more room.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Forms of address by gender, then names by gender and script.
_HIS, _HER = "Mr|Herr|Señor|Sr|Monsieur|Sir|Господин|Г-н", "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Госпожа|Г-жа"
_ANY = "Dr|Prof|Professor|Doctor|Доктор|Профессор"
_GIVEN = {
    ("his", "latin"): "James Robert John Michael David William Richard Thomas Karl Paul Louis Henri Pierre Carlos Miguel Antonio Otto Felix Hugo Bruno".split(),
    ("her", "latin"): "Mary Patricia Linda Elizabeth Barbara Susan Jessica Sarah Anna Clara Louise Marie Sophie Carmen Lucia Elena Greta Ida Nina Vera".split(),
    ("his", "cyrillic"): "Иван Пётр Сергей Андрей Николай Дмитрий Алексей Михаил Павел Борис".split(),
    ("her", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Нина".split(),
}
_FAMILY = {
    "latin": "Smith Johnson Brown Taylor Wilson Clark Lewis Walker Hall Young Schmidt Weber Wagner Becker Martin Bernard Dubois Garcia Lopez Moreno".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров".split(),
}
#: Syllables that further names are made of: first ones, middle ones, and endings of family names and of given names by gender.
_SYLLABLES = {
    "latin": ("Bar Cor Dal Fen Gar Hal Jor Kel Lan Mor Nor Pol Ren Sal Tor Val Wen Zan".split(), "ba de li mo ne ra ri so ta ve vi zo".split(), {"family": "berg court dorf field man mann sen ton well witz".split(), "his": "ard bert ian nard rick ton us win".split(), "her": "anne bella ina issa lina nelle ora ria".split()}),
    "cyrillic": ("Бар Вал Гор Дан Зар Кор Лен Мар Нор Рад Сав Тар Фед Яр".split(), "ба ви го де ла ми на ри со та".split(), {"family": "енов инов аев алов ецов".split(), "his": "ан ей имир ислав он".split(), "her": "ана ина ия ислава ена".split()}),
}
_TITLE = "(?:(?:" + "|".join((_HIS, _HER, _ANY)) + r")\.? ){1,3}"
#: In the order in which they are tried at a place. No capturing groups; repeated groups are bounded, so that no text is too long for the matcher's stack.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,63}",
    "secret": _B + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _E,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}" + _E + "|" + _B + r"\d{3}[.-]\d{3}[.-]\d{4}" + _E + "|" + _B + r"0\d{2,4}[ /-]\d{6,8}" + _E,
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "card": r"(?<![\p{L}\p{N}.-])(?:(?:\d{4}[ -]?){3}\d{4}(?!\d)|\d(?:[ -]?\d){12,18})" + _E,
    "name": r"(?<!\p{L})" + _TITLE + r"\p{Lu}\p{Ll}+(?: \p{Lu}\.)?(?: \p{Lu}\p{Ll}+)?",
}
#: A cheap test that passes whatever some pattern matches.
_MAYBE = r"[@]|\d[\d .()/-]{5}|[0-9A-Fa-f]{32}|AKIA|gh[pousr]_|sk-|(?<!\p{L})(?:" + "|".join((_HIS, _HER, _ANY)) + r")\.? \p{Lu}"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets by the class of letters that they stand in for. The last is for any other letter.
_ALPHABETS = [(r"\d", _DIGITS), ("[a-z]", _LOWER), ("[A-Z]", _UPPER), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsHan}", "山川水火木金土日月天人大小中上下"), (r"\p{L}", _LOWER)]


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _stream(seed: Column, size: Column) -> Column:
    """At least `size` hexadecimal digits of hashes of the seed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 128).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("/"), k.cast("string")).cast("binary"), 512)), "")


def _decimal(stream: Column) -> Column:
    """Hexadecimal digits as decimal ones."""
    return F.translate(stream, "abcdef", "158307")


def _reshaped(text: Column, stream: Column) -> Column:
    """Each letter and digit becomes one of its class by two digits of the stream; other characters stay."""

    def one(c, i):
        v = F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda alphabet: F.substr(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))
        return reduce(lambda out, pair: F.when(c.rlike(f"^{pair[0]}$"), pick(pair[1])).otherwise(out), reversed(_ALPHABETS), c)

    return F.array_join(F.transform(_chars(text), one), "")


def _with_digits(format_: Column, digits: Column) -> Column:
    """Puts digits in the places of a text's digits, in order."""
    return F.array_join(F.zip_with(F.split(format_, r"\d", -1), _chars(digits), lambda between, d: F.concat(F.coalesce(between, F.lit("")), F.coalesce(d, F.lit("")))), "")


def _in_case_of(format_: Column, text: Column) -> Column:
    """Letters of a text in capitals where the other text of the same length has them."""
    return F.array_join(F.zip_with(_chars(format_), _chars(text), lambda a, b: F.when(a.rlike(r"^\p{Lu}$"), F.upper(b)).otherwise(b)), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check over all but the last digit, modulo 10."""
    weigh = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10


def _picked(names: list[str], stream: Column, at: int) -> Column:
    """One of the names by four digits of the stream."""
    v = F.conv(F.substr(stream, F.lit(at), F.lit(4)), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), v % len(names) + 1)


def _new_name(script: str, listed: list[str], ending: str, stream: Column, draw: Column) -> Column:
    """A listed name at the first draw; then ones made of syllables, with more of them at each draw."""
    first, middle, last = _SYLLABLES[script]
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(draw - 1, F.lit(1))), lambda k: F.element_at(F.array(*map(F.lit, middle)), F.conv(F.substr(stream, 8 + 2 * F.least(k, F.lit(40)), F.lit(2)), 16, 10).cast("int") % len(middle) + 1)), "")
    made = F.concat(_picked(first, stream, 1), F.when(draw > 1, more).otherwise(F.lit("")), _picked(last[ending], stream, 5))
    return F.when(draw == 0, _picked(listed, stream, 1)).otherwise(made)


def _candidates(open_: DataFrame, key: str, draw: int) -> DataFrame:
    """Adds surrogate, a normalised one, to rows (kind, norm, her)."""
    kind, norm, d, stream = F.col("kind"), F.col("norm"), F.lit(draw), F.col("stream")
    seed = F.concat(F.lit(f"{key}/{draw}/"), kind, F.lit("/"), norm)
    size = F.length(norm)
    rows = open_.withColumn("stream", _stream(seed, 2 * size + 128))
    extra = _decimal(F.substr(stream, F.lit(1), F.lit(max(0, draw - 7))))  # where a format has no room left
    number = F.concat(_decimal(F.substr(stream, F.lit(1), size)), extra)
    code, local = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
    phone = F.concat(code, F.lit("|"), _decimal(F.substr(stream, F.lit(1), F.length(local))), extra)
    body = _decimal(F.substr(stream, F.lit(1), size - 1))
    last = F.pmod(F.substr(norm, size, F.lit(1)).cast("int") + _luhn(F.substr(norm, F.lit(1), size - 1)) - _luhn(body), F.lit(10))
    card = F.concat(body, last.cast("string"))  # a valid number stays valid
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substr(stream, i, F.lit(2)), 16, 10)), ".")
    head = F.regexp_extract(norm, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    tail = F.substr(norm, F.length(head) + 1)
    hexes = F.substr(stream, F.lit(1), F.length(tail))
    secret = F.when(head != "", F.concat(head, _reshaped(tail, stream))).otherwise(F.when(norm.rlike("[A-F]"), F.upper(hexes)).otherwise(hexes))
    user, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    ending = F.regexp_extract(host, r"\.\p{L}+$", 0)
    labels = F.substr(host, F.lit(1), F.length(host) - F.length(ending))
    own = _stream(F.concat(F.lit(f"{key}/host/"), host, F.lit("" if draw < 3 else f"/{draw}/"), F.lit("") if draw < 3 else user), 2 * size)
    mail = F.concat(_reshaped(user, stream), extra, F.lit("@"), _reshaped(labels, own), ending)
    out = F.when(kind == "email", mail).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "secret", secret).when(kind == "ssn", number)
    for script in _SYLLABLES:
        for gender in ("his", "her"):
            out = out.when((kind == f"given {script}") & (F.col("her") == (gender == "her")), F.lower(_new_name(script, _GIVEN[gender, script], gender, stream, d)))
        out = out.when(kind == f"family {script}", F.lower(_new_name(script, _FAMILY[script], "family", stream, d)))
    return rows.withColumn("surrogate", out).drop("stream")


def surrogates(norms: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate of distinct rows (kind, norm, her): distinct within a kind, and none of them a norm of the corpus."""
    spark = norms.sparkSession
    root = scratch(spark, "surrogates")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norms = written(norms, f"{root}/norms")
    used, open_, done, draw = norms.select("kind", F.col("norm").alias("surrogate")), norms, [], 0
    while True:
        # a task each for a share of them, however small their file is
        tried = written(_candidates(open_.repartition(tasks, "kind", "norm"), key, draw), f"{root}/tried{draw}")
        first = tried.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        good = written(first.join(used, ["kind", "surrogate"], "left_anti").select("kind", "norm", "surrogate"), f"{root}/good{draw}")
        done.append(good)
        used = used.unionByName(good.select("kind", "surrogate"))
        open_ = tried.drop("surrogate").join(good, ["kind", "norm"], "left_anti")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        draw += 1


def _type(entity: Column) -> Column:
    """What a found entity is: the first of the patterns that it matches as a whole; else a name that stood with a form of address elsewhere."""
    bare = lambda p: p.replace(r"(?<![\p{L}\p{N}.-])", "").replace(r"(?<![\p{L}\p{N}+])", "")
    return reduce(lambda out, kind: F.when(entity.rlike("^(?:" + bare(PATTERNS[kind]) + ")$"), F.lit(kind)).otherwise(out), reversed([k for k in PATTERNS if k != "name"]), F.lit("name"))


_HEAD = r"^" + _TITLE


def _norms(entities: DataFrame) -> DataFrame:
    """Adds to rows (type, entity): norm and code of numbers and addresses; title, given and family (in small letters), script and whether a woman is addressed (null if unknown) of names."""
    e, kind = F.col("entity"), F.col("type")
    digits = F.regexp_replace(e, r"\D", "")
    code = F.when(kind == "phone", F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")
    local = F.regexp_replace(F.substr(e, F.length(code) + 1), r"\D", "")
    norm = F.when(kind == "email", F.lower(e)).when(kind == "phone", F.concat(code, F.lit("|"), local)).when(kind.isin("ssn", "card"), digits).when(kind.isin("ip", "secret"), e)
    title = F.when(kind == "name", F.regexp_extract(e, _HEAD, 0)).otherwise("")
    rest = F.split(F.substr(e, F.length(title) + 1), " ")
    given = F.when((kind == "name") & (F.size(rest) > 1), F.lower(rest[0]))
    family = F.when(kind == "name", F.lower(F.element_at(rest, -1)))
    script = F.when(family.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    stem = F.when((script == "cyrillic") & family.rlike("[оеё]ва$|ина$"), F.regexp_replace(family, "а$", "")).otherwise(family)  # a woman's form of a man's name
    her = F.when(title.rlike(r"^(?:" + _HER + r")\b"), True).when(title.rlike(r"^(?:" + _HIS + r")\b"), False)
    return entities.withColumns({"norm": norm, "code": code, "title": title, "given": given, "family": family, "stem": stem, "script": script, "her": her})


def _known(entities: DataFrame, key: str) -> DataFrame:
    """type, entity, surrogate of distinct rows (type, entity)."""
    root = scratch(entities.sparkSession, "entities")
    e = written(_norms(entities), f"{root}/entities")
    listed = reduce(lambda a, b: a | b, [(F.col("script") == s) & F.col("given").isin([n.lower() for n in _GIVEN["her", s]]) for s in _SYLLABLES])
    women, men = F.sum(F.when(F.col("her"), 1).otherwise(0)), F.sum(F.when(~F.col("her"), 1).otherwise(0))
    given = e.where("given is not null").groupBy("script", "given").agg(F.when(women > men, True).when(men > women, False).otherwise(F.max(listed)).alias("her"))
    numbers = e.where("norm is not null").select(F.col("type").alias("kind"), "norm").distinct().withColumn("her", F.lit(False))
    givens = given.select(F.concat(F.lit("given "), "script").alias("kind"), F.col("given").alias("norm"), "her")
    families = e.where("family is not null").select(F.concat(F.lit("family "), "script").alias("kind"), F.col("stem").alias("norm")).distinct().withColumn("her", F.lit(False))
    made = surrogates(numbers.unionByName(givens).unionByName(families), key)
    core, entity = F.col("surrogate"), F.col("entity")
    rows = e.where("norm is not null").join(made.withColumnRenamed("kind", "type"), ["type", "norm"])
    number = F.concat(F.col("code"), _with_digits(F.substr(entity, F.length("code") + 1), F.substring_index(core, "|", -1)))
    out = F.when(F.col("type").isin("phone", "ssn", "card"), number).when(F.col("type") == "email", F.when(F.length(core) == F.length(entity), _in_case_of(entity, core)).otherwise(core)).otherwise(core)
    names = e.where("norm is null").withColumns({"gk": F.concat(F.lit("given "), "script"), "fk": F.concat(F.lit("family "), "script")})
    f = made.select(F.col("kind").alias("fk"), F.col("norm").alias("stem"), F.col("surrogate").alias("new_family"))
    g = made.select(F.col("kind").alias("gk"), F.col("norm").alias("given"), F.col("surrogate").alias("new_given"))
    names = names.join(f, ["fk", "stem"]).join(g, ["gk", "given"], "left")
    new_family = F.concat(F.initcap("new_family"), F.when(F.col("family") != F.col("stem"), "а").otherwise(""))
    middle = F.regexp_extract(entity, r" (\p{Lu}\. )", 1)  # an initial says little; it stays
    name = F.concat("title", F.when(F.col("new_given").isNotNull(), F.concat(F.initcap("new_given"), F.lit(" "))).otherwise(""), F.when(F.col("new_given").isNotNull(), middle).otherwise(""), new_family)
    return rows.select("type", "entity", out.alias("surrogate")).unionByName(names.select("type", "entity", name.alias("surrogate")))


def _found(docs: DataFrame) -> DataFrame:
    """Adds __bare, the names that stand with a form of address in __text, without it, longest first; and __found, the text's entities in their order. Only texts that may hold some are searched in full."""
    text, no = F.col("__text"), F.array().cast("array<string>")
    first = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(no)
    people = F.transform(F.filter("__first", lambda e: e.rlike(_HEAD)), lambda e: F.regexp_replace(e, _HEAD, ""))
    forms = lambda n: F.array(n, F.concat(F.substring_index(n, " ", 1), F.lit(" "), F.substring_index(n, " ", -1)), F.substring_index(n, " ", -1))
    bare = F.filter(F.array_distinct(F.flatten(F.transform(people, forms))), lambda n: (F.length(n) > 2) & ~n.rlike(r"^(\S+) \1$"))
    longest = F.reverse(F.transform(F.array_sort(F.transform(bare, lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))), lambda x: x["name"]))
    rows = docs.withColumn("__first", first)
    rows = rows.withColumn("__bare", F.when(F.exists("__first", lambda e: e.rlike(_HEAD)), longest).otherwise(no))
    again = F.regexp_extract_all(text, _pattern(), F.lit(0))
    return rows.withColumn("__found", F.when(F.size("__bare") > 0, again).otherwise(F.col("__first"))).drop("__first")


def _pattern() -> Column:
    """The patterns, and the names that are known of this text."""
    names = F.transform("__bare", lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E")))
    return F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))


def replace_private(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """The documents' columns with entities in text replaced, and n_private: how many were.

    Null texts stay null, texts without entities stay as they are; all columns and repeated rows are kept, except that a
    column named n_private gives way to this operator's. The same key gives the same surrogates for the same corpus. Texts
    are searched once; rows are kept with what was found in a table of the shared folder, and only those with entities are
    shuffled, by a hash of the text, so that copies share one set of surrogates.
    """
    root = scratch(docs.sparkSession, "private")
    columns = [c for c in docs.columns if c != "n_private"]
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("__row"), docs["text"].cast("string").alias("__text"))
    marked = written(_found(rows).drop("__text"), f"{root}/marked", "zstd")
    text = F.col("__row.text").cast("string")
    kept = [F.col("__row")[c].alias(c) for c in columns]
    without = marked.where("size(__found) <= 0 or __found is null").select(*kept, F.lit(0).cast("long").alias("n_private"))
    holds = marked.where("size(__found) > 0").withColumns({"__h": F.xxhash64(text), "__g": F.hash(text, F.lit(1))})
    names = ["__h", "__g"]
    seen = written(holds.select(*names, "__found").distinct().select(*names, F.explode(F.array_distinct("__found")).alias("entity")).withColumn("type", _type(F.col("entity"))), f"{root}/seen")
    known = written(_known(seen.select("type", "entity").distinct(), key), f"{root}/known")
    maps = seen.select(*names, "entity", "type").distinct().join(known, ["type", "entity"]).groupBy(*names).agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("__map"))
    met = holds.join(maps, names).withColumn("__text", text)
    between = F.when(F.size("__bare") > 0, F.split(F.col("__text"), _pattern(), -1)).otherwise(F.split(F.col("__text"), PATTERN, -1))
    parts = F.zip_with(between, F.col("__found"), lambda b, e: F.concat(b, F.coalesce(F.element_at(F.col("__map"), e), F.lit(""))))
    changed = [F.array_join(parts, "").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in columns]
    return without.unionByName(met.select(*changed, F.size("__found").cast("long").alias("n_private")))
