"""Surrogates for personal data, by DataFrame expressions alone.

Entities are found by one pattern. Each distinct entity gets a keyed replacement of its own type and format: digits for
digits, letters for letters in the same script and case, addresses that are addresses, names by gender and script. What an entity gets depends on the key and
its normal form, so it is the same wherever it occurs and however it is written (coreference). Replacements are
checked over the whole corpus: of entities that would get the same one, or one that is itself an entity, all but the first try
again with the next keyed draw, until each has one of its own (distinctness). Card numbers and IBANs whose check digits are right get
right ones; Cyrillic surnames in -ов, -ев, -ин and their forms in -а share one replacement, with and without -а.

Names are found by their titles; within a text, words of such names are replaced where they stand without a title too, alike.

Distinct entities are aggregated before they are shuffled, so one that is in a third of all texts is a row a task. Texts without
entities are never shuffled.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import cut, parted

# Titles by gender, letters, syllables.
TITLES = {
    "m": "Mr Mister Herr Señor Sr Don Monsieur господин Господин".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Srta Doña Madame Mme Mademoiselle Mlle госпожа Госпожа".split(),
    "n": "Dr Prof Professor".split(),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ha he ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до жа за зи ка ке ки ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се си та те ти".split(),
    "greek": "βα βε γα γο δα δε ζα θε κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "a", "n": "s"},
    "cyrillic": {"m": "н", "f": "а", "n": "с"},
    "greek": {"m": "ς", "f": "α", "n": "ν"},
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_END = r"(?![\p{L}\p{N}])"
#: Each begins where no letter or digit stands before.
PATTERNS = {
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d){_END}",
    "ip6": rf"(?:(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{2,6}}(?::[0-9a-fA-F]{{1,4}}){{1,5}})(?!:){_END}",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}(?!-){_END}",
    "card": rf"\d(?:[ -]?\d){{12,18}}{_END}",
    "phone": rf"(?:\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?\d{{2,4}}){{2,4}}|\(\d{{2,4}}\) ?\d{{3,4}}[ .-]\d{{3,4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}){_END}",
    "secret": rf"(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}|sk-[A-Za-z0-9_-]{{20,}}|xox[abps]-[A-Za-z0-9-]{{10,}})(?!_){_END}",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "name": rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+",
}
#: One pattern: what a token begins with says which kinds it may be, so that most tokens are tried for few. What else must not stand
#: before it is up to the kind: a dot before an IP, a hyphen before a social security number, _ before a secret, and all that mail addresses are made of before one.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    + rf"(?=[0-9a-fA-F]{{1,4}}:)(?<!:)(?:{PATTERNS['ip6']})|"
    + rf"(?=[\d+(])(?:(?<!\.){PATTERNS['ip']}|(?<!-){PATTERNS['ssn']}|{PATTERNS['card']}|{PATTERNS['phone']})"
    + rf"|(?=[0-9a-fA-Fgsx])(?<!_)(?:{PATTERNS['secret']})"
    + rf"|(?=[A-Z][A-Z])(?:{PATTERNS['iban']})"
    + rf"|(?=[\p{{Lu}}г])(?:{PATTERNS['name']})"
    + rf"|(?<![._%+-]){PATTERNS['email']})"
)
#: A word that may be a name without its title; a possessive ending is taken off before it is looked up.
BARE = rf"(?<![\p{{L}}\p{{N}}]){_NAME}{_END}"
_POSSESSIVE = "['’]s\\z"
_SLAVIC = "(ов|ев|ёв|ин|ын)"
#: After so many draws each, names, mail addresses and phones get one more syllable, letter or digit, so that short ones never run out of forms.
GROW = 4
#: Rounds in succession in which no entity found a free replacement, after which a kind of fixed length counts as full (social security numbers have 10**9 forms, others more).
STALLED = 64


def _kind(m: Column) -> Column:
    out = F.lit("name")
    for k in ("email", "iban", "secret", "phone", "card", "ssn", "ip6", "ip"):
        out = F.when(m.rlike(rf"\A(?:{PATTERNS[k]})\z"), F.lit(k)).otherwise(out)
    return out


def _gender(title: Column) -> Column:
    return F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")


def _parts(found: DataFrame) -> DataFrame:
    """(m, pos, kind, raw, norm): what of a match m is replaced as one. Names are replaced word by word."""
    typed = found.withColumn("kind", _kind(F.col("m")))
    title = F.regexp_extract("m", rf"\A({_TITLE})\.? ", 1)
    names = typed.where("kind = 'name'").select("m", _gender(title).alias("g"), F.posexplode(F.split(F.regexp_replace("m", rf"\A(?:{_TITLE})\.? ", ""), " ")).alias("pos", "raw"), F.size(F.split("m", " ")).alias("n"))
    names = names.select("m", "pos", F.when((F.col("pos") == 0) & (F.col("n") > 2), F.concat(F.lit("given_"), "g")).otherwise("surname").alias("kind"), "raw", F.lower("raw").alias("norm"))
    names = names.withColumn("norm", F.when(F.col("kind") == "surname", F.regexp_replace("norm", f"(?<={_SLAVIC})а\\z", "")).otherwise(F.col("norm")))
    plain = F.lower(F.regexp_replace("m", r"[^\p{L}\p{N}]", ""))
    others = typed.where("kind <> 'name'").select("m", F.lit(0).alias("pos"), "kind", F.col("m").alias("raw"), F.when(F.col("kind").isin("email", "ip", "ip6", "secret"), F.lower("m")).otherwise(plain).alias("norm"))
    return names.union(others)


def _draw(h: str, i: str, n: int | str) -> str:
    return f"cast(pmod(xxhash64({h}, {i}), {n}) as int)"


def _candidate(more: int = 0) -> str:
    """SQL of a draw for (kind, norm) by the keyed hash h, longer by `more` where the kind may grow. Kept are a mail address's top domain, country codes and a card's first digit."""
    keep = "if(kind = 'email', length(norm) - length(substring_index(norm, '.', -1)), length(norm))"
    first = "case kind when 'phone' then greatest(0, length(norm) - 10) when 'iban' then 2 when 'card' then 1 else 0 end"
    pick = lambda s, i="i": f"substring('{LETTERS[s]}', 1 + {_draw('h', i, len(LETTERS[s]))}, 1)"
    char = (
        f"case when i < {first} or i >= {keep} then c "
        f"when c between '0' and '9' and kind = 'secret' and norm rlike '^[0-9a-f]+$' then substring('0123456789abcdef', 1 + {_draw('h', 'i', 16)}, 1) "
        f"when c between 'a' and 'f' and kind = 'secret' and norm rlike '^[0-9a-f]+$' then substring('0123456789abcdef', 1 + {_draw('h', 'i', 16)}, 1) "
        f"when kind = 'ip6' and c <> ':' then substring('0123456789abcdef', 1 + {_draw('h', 'i', 16)}, 1) "
        f"when c rlike '\\\\p{{N}}' then cast({_draw('h', 'i', 10)} as string) "
        f"when c between 'Ͱ' and 'Ͽ' then {pick('greek')} when c between 'Ѐ' and 'ӿ' then {pick('cyrillic')} "
        f"when c rlike '\\\\p{{L}}' then {pick('latin')} else c end"
    )
    by_char = f"array_join(transform(filter(split(norm, ''), c -> c <> ''), (c, i) -> {char}), '')"
    if more:
        extra = lambda x: f"array_join(transform(sequence(1, {more}), i -> {x}), '')"
        by_char = f"concat(if(kind = 'email', {extra(pick('latin', '-i'))}, ''), {by_char}, if(kind = 'phone', {extra(f'cast({_draw("h", "-i", 10)} as string)')}, ''))"
    octets = f"array_join(transform(sequence(0, 3), i -> cast(if(i = 0, 1 + {_draw('h', 'i', 223)}, {_draw('h', 'i', 256)}) as string)), '.')"

    def name(script: str) -> str:
        array = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        body = f"array_join(transform(sequence(1, greatest(2, least(5, (length(norm) + 1) div 2)) + {more}), i -> element_at({array}, 1 + {_draw('h', 'i', len(SYLLABLES[script]))})), '')"
        e = ENDINGS[script]
        return f"concat({body}, case kind when 'given_m' then '{e['m']}' when 'given_f' then '{e['f']}' when 'given_n' then '{e['n']}' else {pick(script, '0')} end)"

    names = f"case when kind = 'surname' and norm rlike '{_SLAVIC}$' then regexp_replace({name('cyrillic')}, '..$', 'ов') when norm rlike '[Ѐ-ӿ]' then {name('cyrillic')} when norm rlike '[Ͱ-Ͽ]' then {name('greek')} else {name('latin')} end"
    return f"case when kind = 'ip' then {octets} when kind = 'surname' or kind like 'given%' then {names} else {by_char} end"


def _digits_sum(s: str) -> str:
    """SQL of the Luhn sum of the digits s, modulo 10."""
    return f"aggregate(transform(filter(split(reverse({s}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 0, cast(c as int), cast(2 * cast(c as int) div 10 as int) + 2 * cast(c as int) % 10)), 0, (a, d) -> (a + d) % 10)"


def _remainder(s: str) -> str:
    """SQL of the remainder of an IBAN s (lower case) by 97."""
    value = "instr('0123456789abcdefghijklmnopqrstuvwxyz', c) - 1"
    return f"aggregate(filter(split(concat(substring({s}, 5), substring({s}, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> (a * if(c between '0' and '9', 10, 100) + {value}) % 97)"


def _checked() -> str:
    """SQL of the draw s with right check digits, where `norm` has right ones."""
    zero = lambda s: f"concat(substring({s}, 1, length({s}) - 1), '0')"
    unset = "concat(substring(s, 1, 2), '00', substring(s, 5))"
    return (
        f"case when kind = 'card' and norm rlike '^[0-9]+$' then if({_digits_sum('norm')} = 0, concat(substring(s, 1, length(s) - 1), cast((10 - {_digits_sum(zero('s'))}) % 10 as string)), s) "
        f"when kind = 'iban' then if({_remainder('norm')} = 1, concat(substring(s, 1, 2), lpad(cast(98 - {_remainder(unset)} as string), 2, '0'), substring(s, 5)), s) else s end"
    )


def _rendered() -> str:
    """SQL of the replacement s of `norm` in the writing of `raw`: its separators and its case."""
    alnum = r"'[^\\p{L}\\p{N}]'"
    more = "length(s) - length(norm)"
    s = f"case kind when 'email' then substring(s, 1 + {more}) else s end"
    same = f"length(raw) = length({s})"
    at = f"if({same}, i + 1, length(regexp_replace(substring(raw, 1, i + 1), {alnum}, '')))"
    char = f"case when kind in ('phone', 'card', 'ssn', 'iban') and regexp_replace(c, {alnum}, '') = '' then c when c = upper(c) and c <> lower(c) then upper(substring({s}, {at}, 1)) else substring({s}, {at}, 1) end"
    feminine = "if(kind = 'surname' and lower(raw) = concat(norm, 'а'), 'а', '')"
    return (
        "case when kind = 'ip' then s "
        "when kind = 'ip6' or kind = 'secret' and raw rlike '^[0-9A-F]+$' then if(raw = upper(raw) and raw <> lower(raw), upper(s), s) "
        f"when kind = 'surname' or kind like 'given%' then if(raw = upper(raw), upper(concat(s, {feminine})), concat(upper(substring(s, 1, 1)), substring(s, 2), {feminine})) "
        f"else concat(if(kind = 'email', substring(s, 1, {more}), ''), array_join(transform(filter(split(raw, ''), c -> c <> ''), (c, i) -> {char}), ''), if(kind = 'phone', substring(s, 1 + length(norm)), '')) end"
    )


def _replacements(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, s) of the distinct (kind, norm): s is unlike all norms of the kind and unlike every other s of it."""
    space = F.when(F.col("kind").like("given%") | (F.col("kind") == "surname"), F.lit("name")).otherwise(F.col("kind"))
    entities = entities.withColumn("space", space)
    taken = entities.select("space", F.col("norm").alias("s")).distinct()
    todo, done, left, stalled = cut(entities), None, -1, 0
    for draw in itertools.count():
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.lit(str(draw))), 256)
        tried = todo.withColumn("h", h).withColumn("s", F.expr(_candidate(draw // GROW))).withColumn("s", F.expr(_checked())).drop("h")
        free = tried.join(taken, ["space", "s"], "left_anti")
        first = free.groupBy("space", "s").agg(F.min(F.struct("kind", "norm")).alias("w"))
        won = first.select("space", F.col("w.kind").alias("kind"), F.col("w.norm").alias("norm"), "s")
        won = cut(won)
        done = won if done is None else done.union(won)
        todo = cut(todo.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        before, left = left, todo.count()
        if left == 0:
            return done.select("kind", "norm", "s")
        stalled = stalled + 1 if left == before else 0
        if stalled == STALLED:
            raise ValueError(f"{left} entities whose kind has no free replacement of its fixed length")
        taken = taken.union(won.select("space", "s"))


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, where each entity of the text is replaced, and n_entities (long; dropped first if docs have it).

    Null texts stay null, with no entities; empty and clean texts stay as they are. Repeated rows, and rows with null ids,
    are each replaced alike: what replaces an entity depends on the key and the entities of the corpus only. Names without
    a title count as entities where their words stand in a titled name of the same text; a word that is both a given name and
    a surname there is taken for the surname. Very long texts are handled like others, in time that grows with their length
    (times the number of their names, for capitalised words of texts that have any). An empty table gives an empty one.
    """
    docs = docs.drop("n_entities")
    text = F.col(text_col)
    keyed = docs.withColumn("__sha", F.sha2(text, 256))
    found = keyed.select("__sha", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("ms")).where(F.size("ms") > 0)
    found = cut(found.dropDuplicates(["__sha"]))
    parts = cut(_parts(found.select(F.explode("ms").alias("m")).distinct()))
    new = _replacements(parts.select("kind", "norm").distinct(), key)
    told = parts.join(new, ["kind", "norm"]).select("m", "pos", "kind", "raw", F.expr(_rendered()).alias("r"))
    title = F.regexp_extract("m", rf"\A((?:{_TITLE})\.? )", 1)
    told = told.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "raw", "kind"))).alias("ws"))
    named = F.element_at("ws", 1)["kind"].isin("surname", "given_m", "given_f", "given_n")
    whole = F.array_join(F.transform("ws", lambda x: x["r"]), " ")
    told = cut(told.select("m", F.when(named, F.concat(title, whole)).otherwise(whole).alias("r"), F.when(named, F.col("ws")).alias("ws")))
    each = found.select("__sha", F.posexplode("ms").alias("i", "m")).join(told, "m")
    lists = each.groupBy("__sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("__r"))
    words = each.select("__sha", F.explode("ws").alias("w")).groupBy("__sha", F.col("w.raw").alias("raw")).agg(F.max(F.struct("w.kind", "w.r")).alias("w"))
    words = words.groupBy("__sha").agg(F.map_from_entries(F.collect_list(F.struct("raw", F.col("w.r")))).alias("__names"))
    lists = cut(lists.join(words, "__sha", "left"))
    may, clean = parted(keyed, "__sha", found.select("__sha"))
    left = may.join(lists, "__sha", "left")

    def bare(w: Column) -> Column:
        """What replaces the word w, null if it is no name of this text."""
        end = F.regexp_extract(w, _POSSESSIVE, 0)
        return F.coalesce(F.element_at("__names", w), F.concat(F.element_at("__names", F.regexp_replace(w, _POSSESSIVE, "")), end))

    def unnamed(p: Column) -> Column:
        """The stretch p between entities, its bare names replaced."""
        new = F.transform(F.regexp_extract_all(p, F.lit(BARE), F.lit(0)), lambda w: F.coalesce(bare(w), w))
        return F.array_join(F.transform(F.split(p, BARE), lambda q, j: F.concat(q, F.coalesce(F.get(new, j), F.lit("")))), "")

    def mentions(p: Column) -> Column:
        return F.size(F.filter(F.regexp_extract_all(p, F.lit(BARE), F.lit(0)), lambda w: bare(w).isNotNull()))

    pieces = F.split(text, PATTERN)
    some = F.col("__names").isNotNull()
    parts_of = F.transform(pieces, lambda p, i: F.concat(F.when(some, unnamed(p)).otherwise(p), F.coalesce(F.get("__r", i), F.lit(""))))
    more = F.when(some, F.aggregate(pieces, F.lit(0), lambda a, p: a + mentions(p))).otherwise(0)
    left = left.withColumn("n_entities", (F.coalesce(F.size("__r"), F.lit(0)) + more).cast("long")).withColumn(text_col, F.when(F.col("__r").isNotNull(), F.array_join(parts_of, "")).otherwise(text))
    columns = [*docs.columns, "n_entities"]
    return clean.withColumn("n_entities", F.lit(0).cast("long")).select(*columns).unionByName(left.select(*columns))
