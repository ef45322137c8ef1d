"""Check digits as native expressions: Column of text in, Column of boolean out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.fixed_values import BASE58_ALPHABET, BECH32_ALPHABET, FR_NUMBER_PREFIXES, TOP_LEVEL_DOMAINS
from maskline.functions.text import let


def alnum(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def nir_key(body: Column) -> Column:
    """Key of the 13 first characters: 97 - number mod 97, Corsica's 2A and 2B read as 19 and 18."""
    number = F.replace(F.replace(body, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return F.lit(97) - F.pmod(number.try_cast("bigint"), F.lit(97))


def valid_nir(value: Column) -> Column:
    return let(
        alnum(value),
        lambda v: (F.length(v) == 15)
        & F.coalesce(nir_key(F.substring(v, 1, 13)) == F.substring(v, 14, 2).try_cast("bigint"), F.lit(False)),
    )


def fiscal_key(body: Column) -> Column:
    return body.try_cast("bigint") % 511


def valid_fiscal_number(value: Column) -> Column:
    return let(
        alnum(value),
        lambda v: (F.length(v) == 13)
        & F.coalesce(fiscal_key(F.substring(v, 1, 10)) == F.substring(v, 11, 3).try_cast("bigint"), F.lit(False)),
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn total of a digit string whose last digit is the check digit."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    weighted = F.transform(
        numbers, lambda n, i: F.when(i % 2 == 0, n).when(n * 2 > 9, n * 2 - 9).otherwise(n * 2)
    )
    return F.aggregate(weighted, F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0)))


def valid_luhn(value: Column) -> Column:
    return let(F.regexp_replace(value, "[^0-9]", ""), lambda v: (F.length(v) >= 12) & (luhn_sum(v) % 10 == 0))


def mod97(characters: Column) -> Column:
    """Remainder by 97 of an alphanumeric string, letters read as 10 to 35, folded so that it never overflows."""

    def step(acc: Column, c: Column) -> Column:
        digit = F.conv(c, 36, 10).cast("int")
        return F.when(digit > 9, (acc * 100 + digit) % 97).otherwise((acc * 10 + digit) % 97)

    return F.aggregate(F.filter(F.split(characters, ""), lambda c: c != ""), F.lit(0), step)


def valid_iban(value: Column) -> Column:
    return let(
        alnum(value), lambda v: mod97(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))) == 1
    )


def iban_key(country: Column, bban: Column) -> Column:
    return F.lpad((F.lit(98) - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")


def national_phone(value: Column) -> Column:
    """French number without its leading 0 or +33 / 0033, digits only."""
    digits = F.regexp_replace(F.regexp_replace(value, r"\(0\)", ""), "[^0-9+]", "")
    return F.regexp_replace(digits, r"^(?:\+33|0033|0)", "")


def valid_fr_phone(value: Column) -> Column:
    prefixes = "|".join(FR_NUMBER_PREFIXES)
    return national_phone(value).rlike(f"^(?=[0-9]{{9}}$)(?:{prefixes})")


def valid_ip(value: Column) -> Column:
    """IPv4 octets within range; IPv6 of eight groups, or fewer with one `::`."""
    octets = F.split(value, r"\.")
    v4 = (F.size(octets) == 4) & F.forall(octets, lambda o: o.rlike("^[0-9]{1,3}$") & (o.try_cast("int") <= 255))
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    folded = F.size(F.split(value, "::")) == 2
    v6 = ~value.contains(":::") & ((folded & (groups <= 7)) | (~value.contains("::") & (groups == 8)))
    v6 = v6 & F.forall(F.split(value, ":"), lambda g: F.length(g) <= 4)
    return F.when(value.contains(":"), v6).otherwise(v4)


def known_domain(value: Column) -> Column:
    """The last label of the name is a known top-level domain."""
    return F.lower(F.substring_index(value, ".", -1)).isin(TOP_LEVEL_DOMAINS)


LIMB = (1 << 40) - 1


def _base58_hex(value: Column) -> Column:
    """The 25 bytes of a base-58 number as 50 hex digits: five 40-bit limbs, folded over the characters."""

    def step(acc: Column, c: Column) -> Column:
        carry = (F.instr(F.lit(BASE58_ALPHABET), c) - 1).cast("bigint")
        limbs = []
        for i in range(5):
            total = acc[i] * 58 + carry
            limbs.append(total.bitwiseAND(F.lit(LIMB).cast("bigint")))
            carry = F.shiftright(total, 40)
        return F.array(*limbs)

    zero = F.array(*[F.lit(0).cast("bigint")] * 5)
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(
        chars, zero, step, lambda a: F.concat(*[F.lpad(F.hex(a[i]), 10, "0") for i in (4, 3, 2, 1, 0)])
    )


def valid_base58(value: Column) -> Column:
    """Wallet address whose last four bytes are the double SHA-256 of the others."""

    def checked(h: Column) -> Column:
        once = F.unhex(F.sha2(F.unhex(F.substring(h, 1, 42)), 256))
        return F.upper(F.substring(F.sha2(once, 256), 1, 8)) == F.substring(h, 43, 8)

    return let(_base58_hex(value), checked)


def valid_bech32(value: Column) -> Column:
    """Checksum of a bc1 address, first or later version (constants 1 and 0x2bc830a3 of the public standard)."""
    generators = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
    data = F.transform(
        F.filter(F.split(F.substring(F.lower(value), 4, 100), ""), lambda c: c != ""),
        lambda c: (F.instr(F.lit(BECH32_ALPHABET), c) - 1).cast("bigint"),
    )
    expanded = F.concat(F.array(*[F.lit(v).cast("bigint") for v in (3, 3, 0, 2, 3)]), data)

    def step(acc: Column, v: Column) -> Column:
        # The accumulator is used six times per step: let() keeps the expression small.
        def mixed(a: Column) -> Column:
            out = F.shiftleft(a.bitwiseAND(F.lit(0x1FFFFFF).cast("bigint")), 5).bitwiseXOR(v)
            for i, g in enumerate(generators):
                bit = F.shiftright(a, 25 + i).bitwiseAND(F.lit(1).cast("bigint"))
                out = out.bitwiseXOR(F.when(bit == 1, F.lit(g).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            return out

        return let(acc, mixed)

    return F.aggregate(expanded, F.lit(1).cast("bigint"), step).isin(1, 0x2BC830A3)


def valid_wallet(value: Column) -> Column:
    return F.when(F.lower(value).startswith("bc1"), valid_bech32(value)).otherwise(
        (F.length(value) <= 35) & valid_base58(value)
    )
