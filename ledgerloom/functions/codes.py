"""Digits, identifiers and barcodes, and how alike two codes are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import let


def only_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9]", "")


def digits_of_number(value: Column) -> Column:
    """Digits of a spreadsheet cell read as a double: an integral number has no trailing .0."""
    return F.when(value == F.floor(value), F.abs(F.floor(value)).cast("string")).otherwise(only_digits(value))


def padded(digits: Column, size: int) -> Column:
    """Zeros before, never cut (lpad alone cuts)."""
    return F.when((digits != "") & (F.length(digits) < size), F.lpad(digits, size, "0")).otherwise(digits)


def normalize_tax_id(text: Column) -> Column:
    return padded(only_digits(text), 14)


def normalize_branch_code(text: Column) -> Column:
    return padded(only_digits(text), 5)


def normalize_barcode(text: Column) -> Column:
    """Digits without leading zeros; all zeros stay."""
    digits = only_digits(text)
    return F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), digits)


def ledger_code(barcode: Column) -> Column:
    digits = only_digits(barcode)
    return F.when(F.length(digits) < 13, F.lpad(digits, 13, "0")).otherwise(digits)


def image_id(file: Column, page: Column, position: Column) -> Column:
    return F.concat(file, F.lit("#p"), page.cast("string"), F.lit("b"), position.cast("string"))


def code_distance(left: Column, right: Column) -> Column:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice. Null counts as empty.

    Swaps can only shorten the built-in distance: at 0 or 1 it stands, at 2 it is 1 if one swap of neighbours makes the
    texts equal, and where the texts have no two neighbours in opposite order it stands as well. The rest is compared by
    bit vectors, if it is digits, and else by the table: two of its rows are carried along an outer fold over
    `left`; an inner fold over `right` appends the next row.
    """
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    exact = F.when(F.rlike(a, F.lit(f"^[0-9]{{1,{WORD}}}$")), bit_aligned(a, b)).otherwise(aligned(a, b))
    return let(F.levenshtein(a, b), lambda plain: F.when(plain <= 1, plain).when(plain == 2, F.when(one_swap(a, b), 1).otherwise(2)).when(~crossed(a, b), plain).otherwise(exact))


#: Digits of a code that fit into a bit vector, with room for a carry.
WORD = 60


def bit_aligned(a: Column, b: Column) -> Column:
    """The distance of a code `a` of 1 to WORD digits to any text, linear in `b`.

    A column of the table is kept as the places where it grows (`up`) or falls (`down`) by one from a row to the next, one bit a
    row; each letter of `b` makes the next column with a sum and a few shifts. `same` are the rows where that letter stands
    in `a`, `level` those whose cell is that of the row and column before; `turned` are rows where two neighbours of `a` are those of `b`
    in opposite order and no such step came before. The last row's changes are summed up.
    """
    bits = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    digits = "0123456789"
    spots = [F.conv(F.reverse(F.translate(a, digits, "".join("1" if k == d else "0" for k in digits))), 2, 10).cast("bigint") for d in digits]
    start = F.struct((bits(F.length(a)) - 1).alias("up"), *[F.lit(0).cast("bigint").alias(c) for c in ("down", "level", "before")], F.length(a).alias("far"))

    def fold(known: Column) -> Column:
        every = F.get(known, F.lit(10))

        def step(s: Column, i: Column) -> Column:
            same = F.coalesce(F.get(known, F.ascii(F.substring(b, i, F.lit(1))) - 48), F.lit(0).cast("bigint"))

            def level(same: Column) -> Column:
                turned = F.shiftleft(F.bitwise_not(s["level"]).bitwiseAND(same), 1).bitwiseAND(s["before"])
                grown = (same.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])
                return grown.bitwiseOR(same).bitwiseOR(s["down"]).bitwiseOR(turned).bitwiseAND(every)

            def ahead(lev: Column) -> Column:
                """How the cells change from the last column to this one: struct of rows that grow and that fall."""
                return F.struct(s["down"].bitwiseOR(F.bitwise_not(lev.bitwiseOR(s["up"])).bitwiseAND(every)).alias("grow"), lev.bitwiseAND(s["up"]).alias("fall"), lev.alias("level"))

            def column(same: Column) -> Column:
                def put(x: Column) -> Column:
                    grow, fall = F.shiftleft(x["grow"], 1).bitwiseOR(F.lit(1).cast("bigint")), F.shiftleft(x["fall"], 1)
                    last = every.bitwiseXOR(F.shiftright(every, 1))
                    return F.struct(
                        fall.bitwiseOR(F.bitwise_not(x["level"].bitwiseOR(grow))).bitwiseAND(every).alias("up"),
                        grow.bitwiseAND(x["level"]).bitwiseAND(every).alias("down"),
                        x["level"].alias("level"),
                        same.alias("before"),
                        (s["far"] + F.when(x["grow"].bitwiseAND(last) != 0, 1).when(x["fall"].bitwiseAND(last) != 0, -1).otherwise(0)).alias("far"),
                    )

                return let(let(level(same), ahead), put)

            return let(same, column)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), start, step, lambda s: s["far"])

    return F.when(F.length(b) == 0, F.length(a)).otherwise(let(F.array(*spots, bits(F.length(a)) - 1), fold))


def one_swap(a: Column, b: Column) -> Column:
    """Whether a swap of two neighbours turns one into the other."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), lambda i: swapped(i) == b)


def crossed(a: Column, b: Column) -> Column:
    """Whether two neighbours of one stand in the other in opposite order."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), lambda i: (F.length(a) > 1) & F.contains(b, F.concat(F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)))))


def aligned(a: Column, b: Column) -> Column:
    """The distance by its table."""

    def letter(text: Column, i: Column) -> Column:
        return F.substring(text, i, F.lit(1))

    def row(rows: Column, i: Column) -> Column:
        one, two = rows["one"], rows["two"]

        def cell(done: Column, j: Column) -> Column:
            swap = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            near = F.least(F.element_at(done, -1) + 1, F.get(one, j) + 1, F.get(one, j - 1) + F.when(letter(a, i) == letter(b, j), 0).otherwise(1))
            return F.concat(done, F.array(F.when(swap, F.least(near, F.get(two, F.greatest(j - 2, F.lit(0))) + 1)).otherwise(near)))

        return F.struct(F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell).alias("one"), one.alias("two"))

    first = F.sequence(F.lit(0), F.length(b))
    whole = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(first.alias("one"), first.alias("two")), row, lambda rows: F.element_at(rows["one"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).when(a == b, 0).otherwise(whole)


def control_matches(control: Column, sale_number: Column) -> Column:
    """Whether the handwritten control number, whole or its first three digits, with or without leading zeros, ends the sale number; two digits at least."""
    digits = only_digits(control)
    tried = F.array(digits, F.regexp_replace(digits, "^0+", ""), F.substring(digits, 1, 3), F.regexp_replace(F.substring(digits, 1, 3), "^0+", ""))
    return F.coalesce(F.exists(tried, lambda c: (F.length(c) >= 2) & F.endswith(sale_number, c)), F.lit(False))
