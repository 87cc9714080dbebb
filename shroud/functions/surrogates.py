"""Seed and surrogate generators (G1-G15) as native SQL expressions.

The seed is HMAC-SHA256(secret, "sid\\0TYPE\\0trimmed original\\0salt"),
computed inside the engine (``sha2``/``unhex``) from pads derived on the
driver.  Instead of feeding the seed to a PRNG, each generator reads bytes of
the digest directly: byte ``i`` is ``conv(substr(hex, 2i+1, 2), 16, 10)``.
32 bytes cover every format below.

Generators are SQL text over three names: ``h`` (hex digest), ``o``
(original) and ``t`` (canonical type).  A :class:`Dialect` supplies the few
functions that differ between Spark and DuckDB, which lets the DuckDB oracle
evaluate the same rules on the same rows.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference)
# ---------------------------------------------------------------------------
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
VIN_ALPHABET = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"   # no I, O, Q
EMAIL_CONSONANTS = "bcdfghklmnprstv"
EMAIL_VOWELS = "aeiou"
EMAIL_DOMAIN = "@example.com"
PHONE_PREFIX = "+7 9"
PHONE_BLOCK = " 555-"
BIK_PREFIX = "04"
ACCOUNT_PREFIX = "40"


class Dialect:
    name = "spark"

    def byte(self, i: int) -> str:
        # ``b`` is the digest as an array of 8 words of 4 bytes, bound once (see candidate_sql)
        return f"CAST(shiftright(b[{i // 4}], {24 - 8 * (i % 4)}) & 255 AS INT)"

    def s(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def let(self, name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def ndigits(self, o: str) -> str:
        return f"length(regexp_replace({o}, '(?U)\\\\D', ''))"

    def strip(self, o: str) -> str:
        return f"regexp_replace({o}, '(?U)^\\\\s+|\\\\s+$', '')"

    def error(self, msg_sql: str) -> str:
        return f"raise_error({msg_sql})"

    def bigint(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def card_regroup(self, digits: str, o: str) -> str:
        lens = (f"transform(filter(split(replace({o}, '-', ' '), '(?U)\\\\s+'), p -> p <> ''), "
                f"p -> length(regexp_replace(p, '(?U)\\\\D', '')))")
        return (
            f"transform(array({lens}), ls -> CASE WHEN (contains({o}, ' ') OR contains({o}, '-')) "
            f"AND aggregate(ls, 0, (a, b) -> a + b) = length({digits}) "
            f"THEN array_join(transform(ls, (l, i) -> substr({digits}, 1 + aggregate(slice(ls, 1, i), 0, (a, b) -> a + b), l)), "
            f"CASE WHEN contains({o}, ' ') THEN ' ' ELSE '-' END) "
            f"ELSE {digits} END)[0]"
        )

    def hmac_hex(self, ipad: str, opad: str, sid: str, t: str, o: str, salt: str) -> str:
        msg = (f"encode(concat_ws(char(0), {sid}, {t}, {self.strip(o)}, {self.s(salt)}), 'UTF-8')")
        inner = f"sha2(concat(unhex('{ipad}'), {msg}), 256)"
        return f"sha2(concat(unhex('{opad}'), unhex({inner})), 256)"


class DuckDialect(Dialect):
    name = "duckdb"

    def byte(self, i: int) -> str:
        return f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER)"

    def let(self, name: str, value: str, body: str) -> str:
        return f"(SELECT {body} FROM (SELECT {value} AS {name}))"

    def s(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def ndigits(self, o: str) -> str:
        return f"length(regexp_replace({o}, '[^0-9]', '', 'g'))"

    def strip(self, o: str) -> str:
        return f"regexp_replace({o}, '^\\s+|\\s+$', '', 'g')"

    def error(self, msg_sql: str) -> str:
        return f"error({msg_sql})"

    def card_regroup(self, digits: str, o: str) -> str:
        lens = (f"list_transform(list_filter(string_split_regex(replace({o}, '-', ' '), '\\s+'), lambda p: p <> ''), "
                f"lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')))")
        return (
            f"(SELECT CASE WHEN (contains({o}, ' ') OR contains({o}, '-')) AND list_sum(ls) = length({digits}) "
            f"THEN (CASE WHEN contains({o}, ' ') THEN array_to_string(g, ' ') ELSE array_to_string(g, '-') END) "
            f"ELSE {digits} END FROM (SELECT ls, list_transform(range(1, len(ls) + 1), lambda i: "
            f"substr({digits}, CAST(1 + coalesce(list_sum(list_slice(ls, 1, i - 1)), 0) AS INTEGER), ls[i])) AS g "
            f"FROM (SELECT {lens} AS ls)))"
        )

    def hmac_hex(self, ipad: str, opad: str, sid: str, t: str, o: str, salt: str) -> str:
        msg = (f"encode({sid} || chr(0) || {t} || chr(0) || {self.strip(o)} || chr(0) || {self.s(salt)})")
        inner = f"sha256(unhex('{ipad}') || {msg})"
        return f"sha256(unhex('{opad}') || unhex({inner}))"


SPARK = Dialect()
DUCK = DuckDialect()


def _d(D: Dialect, i: int) -> str:
    return f"({D.byte(i)} % 10)"


def _nz(D: Dialect, i: int) -> str:
    return f"(1 + {D.byte(i)} % 9)"


def _cat(D: Dialect, parts) -> str:
    return "(" + " || ".join(D.s(p) if not p.startswith("'") else p for p in parts) + ")"


def _wsum(D: Dialect, digits, weights) -> str:
    return "(" + " + ".join(f"{w} * {x}" for x, w in zip(digits, weights)) + ")"


def gen_inn(D: Dialect) -> str:
    """G1: 10 digits, or 12 when the original has 12 or more digits."""
    d10 = [_d(D, i) for i in range(9)]
    c10 = f"(({_wsum(D, d10, INN10_WEIGHTS)} % 11) % 10)"
    d12 = [_d(D, i) for i in range(10)]
    n11 = f"(({_wsum(D, d12, INN12_WEIGHTS_11)} % 11) % 10)"
    n12 = f"(({_wsum(D, d12 + [n11], INN12_WEIGHTS_12)} % 11) % 10)"
    return (f"CASE WHEN {D.ndigits('o')} >= 12 THEN {_cat(D, d12 + [n11, n12])} "
            f"ELSE {_cat(D, d10 + [c10])} END")


def gen_ogrn(D: Dialect) -> str:
    """13 digits (15 when the original has 15+), first digit 1-9,
    check = body mod 11 (13) or mod 13 (15), mod 10."""
    def one(length: int, mod: int) -> str:
        body = _cat(D, [_nz(D, 0)] + [_d(D, i) for i in range(1, length - 1)])
        return f"({body} || {D.s(f'(({D.bigint(body)} % {mod}) % 10)')})"
    return f"CASE WHEN {D.ndigits('o')} >= 15 THEN {one(15, 13)} ELSE {one(13, 11)} END"


def gen_snils(D: Dialect) -> str:
    """9 digits + 2 check digits (sum d*(9-i) mod 101; 100/101 -> 00);
    dashed layout when the original has a dash."""
    d = [_d(D, i) for i in range(9)]
    rem = f"({_wsum(D, d, [9 - i for i in range(9)])} % 101)"
    check = f"lpad({D.s(f'CASE WHEN {rem} IN (100, 101) THEN 0 ELSE {rem} END')}, 2, '0')"
    digits = f"({_cat(D, d)} || {check})"
    dashed = (f"(substr({digits}, 1, 3) || '-' || substr({digits}, 4, 3) || '-' || "
              f"substr({digits}, 7, 3) || ' ' || substr({digits}, 10, 2))")
    return f"CASE WHEN contains(o, '-') THEN {dashed} ELSE {digits} END"


def _dbl(x: str) -> str:
    return f"(CASE WHEN 2 * {x} > 9 THEN 2 * {x} - 9 ELSE 2 * {x} END)"


def gen_card(D: Dialect) -> str:
    """G4+G5: length of the original if 13..19 digits else 16; first digit
    1-9; Luhn check digit; grouping of the original kept if it adds up."""
    n = D.ndigits("o")
    L = "cl"
    dig = [_nz(D, 0)] + [_d(D, j) for j in range(1, 18)]
    body_all = _cat(D, dig)
    body = f"substr({body_all}, 1, {L} - 1)"
    total = " + ".join(
        f"(CASE WHEN {j} < {L} - 1 THEN (CASE WHEN ({L} - 2 - {j}) % 2 = 0 THEN {_dbl(x)} ELSE {x} END) ELSE 0 END)"
        for j, x in enumerate(dig))
    check = f"((10 - ({total}) % 10) % 10)"
    digits = f"({body} || {D.s(check)})"
    return D.let("cl", f"(CASE WHEN {n} BETWEEN 13 AND 19 THEN {n} ELSE 16 END)", D.card_regroup(digits, "o"))


def gen_bik(D: Dialect) -> str:
    """G6: '04' + 7 digits."""
    return f"('{BIK_PREFIX}' || {_cat(D, [_d(D, i) for i in range(7)])})"


def gen_kpp(D: Dialect) -> str:
    """Digit 1-9, 3 digits, '0', digit 1-5, 3 digits."""
    return _cat(D, [_nz(D, 0), _d(D, 1), _d(D, 2), _d(D, 3), "'0'",
                    f"(1 + {D.byte(4)} % 5)", _d(D, 5), _d(D, 6), _d(D, 7)])


def gen_account(D: Dialect) -> str:
    """G8: '40' + 18 digits."""
    return f"('{ACCOUNT_PREFIX}' || {_cat(D, [_d(D, i) for i in range(18)])})"


def gen_vin(D: Dialect) -> str:
    """17 characters of the 33-letter alphabet."""
    return "(" + " || ".join(
        f"substr('{VIN_ALPHABET}', {D.byte(i)} % {len(VIN_ALPHABET)} + 1, 1)" for i in range(17)) + ")"


def gen_passport(D: Dialect) -> str:
    """G10: 'DDDD DDDDDD', first digit 1-9, whatever the original's layout."""
    return _cat(D, [_nz(D, 0), _d(D, 1), _d(D, 2), _d(D, 3), "' '"] + [_d(D, i) for i in range(4, 10)])


def gen_email(D: Dialect) -> str:
    """2-4 consonant+vowel syllables, a number 1-99 half of the time."""
    nsyl = f"(2 + {D.byte(0)} % 3)"

    def syl(k):
        return (f"substr('{EMAIL_CONSONANTS}', {D.byte(1 + 2 * k)} % {len(EMAIL_CONSONANTS)} + 1, 1) || "
                f"substr('{EMAIL_VOWELS}', {D.byte(2 + 2 * k)} % {len(EMAIL_VOWELS)} + 1, 1)")
    local = (f"{syl(0)} || {syl(1)} || (CASE WHEN {nsyl} >= 3 THEN {syl(2)} ELSE '' END) || "
             f"(CASE WHEN {nsyl} >= 4 THEN {syl(3)} ELSE '' END) || "
             f"(CASE WHEN {D.byte(9)} % 2 = 0 THEN {D.s(f'(1 + {D.byte(10)} % 99)')} ELSE '' END)")
    return f"({local} || '{EMAIL_DOMAIN}')"


def gen_phone(D: Dialect) -> str:
    """G12: '+7 9DD 555-DD-DD', also for non-Russian numbers."""
    return _cat(D, [f"'{PHONE_PREFIX}'", _d(D, 0), _d(D, 1), f"'{PHONE_BLOCK}'", _d(D, 2), _d(D, 3),
                    "'-'", _d(D, 4), _d(D, 5)])


GENERATORS = {
    "INN": gen_inn, "OGRN": gen_ogrn, "SNILS": gen_snils, "CARD": gen_card,
    "BIK": gen_bik, "KPP": gen_kpp, "ACCOUNT": gen_account, "VIN": gen_vin,
    "PASSPORT": gen_passport, "EMAIL": gen_email, "PHONE": gen_phone,
}


def dispatch(D: Dialect, types=None) -> str:
    """Type -> generator over ``h``/``o``/``t``; unknown type fails."""
    types = types or tuple(GENERATORS)
    whens = " ".join(f"WHEN '{ty}' THEN {GENERATORS[ty](D)}" for ty in types)
    return f"CASE t {whens} ELSE {D.error(chr(39) + 'no surrogate generator for type ' + chr(39) + ' || t')} END"


def marker_text(open_: str, label_sql: str, index_sql: str, close: str, D: Dialect = SPARK) -> str:
    """Open + label + ' ' + n + close."""
    return f"('{_q(open_)}' || {label_sql} || ' ' || {D.s(index_sql)} || '{_q(close)}')"


def _q(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def candidate_sql(settings, sid: str, t: str, o: str, salt: str, D: Dialect = SPARK) -> str:
    """Spark SQL: the surrogate candidate of one salt."""
    ipad, opad = settings.hmac_pads()
    h = D.hmac_hex(ipad, opad, sid, "t", "o", salt)
    # t, o, h and b are bound once each through one-element transforms.
    b = "transform(sequence(0, 7), k -> CAST(conv(substr(h, 8 * k + 1, 8), 16, 10) AS BIGINT))"
    return (f"transform(array({t}), t -> transform(array({o}), o -> transform(array({h}), h -> "
            f"transform(array({b}), b -> {dispatch(D)})[0])[0])[0])[0]")


def candidates_sql(settings, sid: str, t: str, o: str, salt_from: int, salt_to: int,
                   D: Dialect = SPARK) -> str:
    """Spark SQL: array of surrogate candidates for salts [salt_from, salt_to)."""
    return f"transform(sequence({salt_from}, {salt_to - 1}), s -> {candidate_sql(settings, sid, t, o, 's', D)})"
