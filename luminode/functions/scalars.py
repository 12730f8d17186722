"""Column expressions over sequences, barcodes, spectra and cells.

All but step_sums stay in the JVM; that one takes whole Arrow batches of sequences in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol K) of DNA duplexes
# (Allawi and SantaLucia 1997), for a step and its reverse complement.
STEPS = {
    "AA": (-7.9, -22.2),
    "TT": (-7.9, -22.2),
    "AT": (-7.2, -20.4),
    "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7),
    "TG": (-8.5, -22.7),
    "GT": (-8.4, -22.4),
    "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0),
    "AG": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.9),
    "CC": (-8.0, -19.9),
}
END_AT, END_GC = (2.3, 4.1), (0.1, -2.8)
GAS_CONSTANT = 1.987
# Channel edges of the lasers' bands, for 63 and 95 channels.
BANDS_63 = (0, 23, 43, 57, 63)
BANDS_95 = (0, 32, 55, 75, 89, 95)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- sequences ---------------------------------------------------------------------------------


def clean_id(c):
    """Slashes as underscores."""
    return F.translate(col(c), "/", "_")


def first_taxid(c):
    """The first of `a;b;...`."""
    return F.element_at(F.split(col(c), ";"), 1)


def reverse_complement(seq):
    return F.reverse(F.translate(col(seq), "ACGTN", "TGCAN"))


def orient(seq, start, end):
    """A sequence as it stands where its hit runs forward (start < end), else its reverse complement."""
    return F.when(col(start) < col(end), col(seq)).otherwise(reverse_complement(seq))


def bound(value, body):
    """body(value) with value computed once per row, not once per element of a lambda in body."""
    return F.transform(F.array(value), body)[0]


def max_homology(q, s, mode: str = "compat"):
    """Longest stretch without mismatch of an aligned pair, in one pass over its places.

    compat: an inner stretch counts as the distance of its two mismatches, one more than its
    length; first and last stretch count exactly. exact: true lengths.
    """
    less = 1 if mode == "exact" else 0
    differ = F.zip_with(F.split(col(q), ""), F.split(col(s), ""), lambda a, b: a != b)
    state = lambda at, last, best: F.struct(at.alias("at"), last.alias("last"), best.alias("best"))

    def step(x, differs):
        gap = F.when(x["last"] < 0, x["at"]).otherwise(x["at"] - x["last"] - less)
        return state(x["at"] + 1, F.when(differs, x["at"]).otherwise(x["last"]), F.when(differs, F.greatest(x["best"], gap)).otherwise(x["best"]))

    found = F.aggregate(differ, state(F.lit(0), F.lit(-1), F.lit(0)), step, lambda x: F.when(x["last"] < 0, x["at"]).otherwise(F.greatest(x["best"], x["at"] - 1 - x["last"])))
    return F.when(F.length(col(q)) == 0, 0).otherwise(found)


def longest_run(q, s):
    """Length of the longest run of equal places."""
    marks = F.array_join(F.zip_with(F.split(col(q), ""), F.split(col(s), ""), lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    return F.when(F.length(col(q)) == 0, 0).otherwise(F.array_max(F.transform(F.split(marks, "0"), F.length)))


def count_of(seq, letters: str):
    return F.length(col(seq)) - F.length(F.translate(col(seq), letters, ""))


def gc_count(seq):
    return count_of(seq, "GCgc")


def step_sums_of(most: int = 1 << 20):
    """The function of an Arrow array of sequences behind step_sums; it holds some `most` letters at a time in numbers."""
    letter = np.full(256, 4, np.int64)
    letter[[ord(x) for x in "ACGT"]] = range(4)
    tenths = np.zeros((2, 25), np.int64)  # whole tenths: running sums are exact
    for step, values in STEPS.items():
        tenths[:, 5 * letter[ord(step[0])] + letter[ord(step[1])]] = [round(10 * v) for v in values]
    names = ["n", "gc", "at_ends", "plain", "h", "s"]

    def some(seqs: pa.Array) -> pa.Array:
        _, offsets, data = seqs.buffers()
        edges = np.frombuffer(offsets, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1] if len(seqs) else np.zeros(1, np.int64)
        codes = letter[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]] if data else np.empty(0, np.int64)
        edges = edges - edges[0]
        first, stop = edges[:-1], edges[1:]

        def summed(values: np.ndarray, stop: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values)])
            return running[np.minimum(stop, len(values))] - running[np.minimum(first, len(values))]

        n = stop - first
        padded = np.append(codes, 4)  # a place to look at for empty sequences
        at = lambda x: np.isin(padded[x], (0, 3)) & (n > 0)
        steps, last = 5 * codes[:-1] + codes[1:], np.maximum(stop - 1, first)
        columns = [n, summed(np.isin(codes, (1, 2)).astype(np.int64), stop), at(first).astype(np.int64) + at(last), summed((codes == 4).astype(np.int64), stop) == 0]
        return pa.StructArray.from_arrays([pa.array(x) for x in (*columns, *(summed(v[steps], last) / 10 for v in tenths))], names)

    def run(seqs: pa.Array) -> pa.Array:
        seqs = pc.fill_null(seqs, "").cast(pa.large_string())
        # running sums take some 50 bytes a letter: a batch of long texts goes in stretches of rows
        stretch = np.cumsum(pc.binary_length(seqs).to_numpy(zero_copy_only=False)) // most
        starts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(seqs)]
        return pa.concat_arrays([some(seqs.slice(a, b - a)) for a, b in zip(starts, starts[1:])])

    run.__annotations__ = {"seqs": pa.Array, "return": pa.Array}
    return run


def step_sums(seq):
    """Struct of n, gc, at_ends (ends that are A or T), plain (no letter but A, C, G, T), and h and s:
    enthalpy and entropy summed over all steps of two neighbouring letters. Null counts as empty.
    """
    return F.arrow_udf(step_sums_of(), "struct<n:long,gc:long,at_ends:long,plain:boolean,h:double,s:double>")(col(seq))


def melting_temperature(seq, sodium: float = 390.0, oligo: float = 5.0, partner: float = 1.0):
    """Nearest-neighbour melting temperature (Celsius) against a perfect complement.

    sodium in mM; oligo, times 15, and partner in nM; salt correction of Owczarzy et al. 2004/2008
    for monovalent ions. Null where a letter is not A, C, G or T, or fewer than two stand there.
    """
    sums = step_sums(seq)
    at_ends, gc_ends = sums["at_ends"], F.lit(2) - sums["at_ends"]
    h = sums["h"] + at_ends * F.lit(END_AT[0]) + gc_ends * F.lit(END_GC[0])
    s = sums["s"] + at_ends * F.lit(END_AT[1]) + gc_ends * F.lit(END_GC[1])
    strands = (oligo * 15 - partner / 2) * 1e-9
    kelvin = 1000 * h / (s + F.lit(GAS_CONSTANT) * F.log(F.lit(strands)))
    ion = F.log(F.lit(sodium * 1e-3))
    gc = sums["gc"] / sums["n"]
    corrected = 1 / (1 / kelvin + (4.29 * gc - 3.95) * F.lit(1e-5) * ion + F.lit(9.40e-6) * ion * ion)
    return F.when((sums["n"] >= 2) & sums["plain"], corrected - 273.15)


def kmers(seq, k: int):
    """All substrings of k letters, in order; one pass, whatever the length (substring would walk from the start each time)."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def quad_g(seq):
    """Runs of four G plus runs of five G, each counted without overlap."""
    return F.regexp_count(col(seq), F.lit("GGGG")) + F.regexp_count(col(seq), F.lit("GGGGG"))


def flank(seq, start, length, size: int = 3):
    """Up to `size` bases left and right of a window (0-based start), clipped to the sequence."""
    left = F.substring(col(seq), F.greatest(col(start) - size, F.lit(0)) + 1, F.least(col(start), F.lit(size)))
    right = F.substring(col(seq), col(start) + col(length) + 1, F.lit(size))
    return left, right


# -- positions, names, oligos ------------------------------------------------------------------


def position_bin(start, width: float):
    return F.floor(col(start) / width)


def interval_end(start, length):
    return col(start) + col(length) - 1


def to_bits(number, width: int):
    return F.lpad(F.bin(col(number)), width, "0")


def from_bits(code):
    return F.conv(col(code), 2, 10).cast("int")


def popcount(number):
    return F.bit_count(col(number))


def project_bits(code, places: tuple[int, ...]):
    """The bits at the given 0-based places, in that order."""
    return F.concat(*[F.substring(col(code), p + 1, 1) for p in places])


def ring_pairs(code):
    """Array of two-bit codes: each set bit with the next one, the last with the first.

    A code with one set bit has none, one with two set bits itself.
    """
    width = F.length(col(code))
    bits = F.filter(F.transform(F.split(col(code), ""), lambda b, i: F.when(b == "1", i + 1)), lambda i: i.isNotNull())
    n = F.size(bits)
    after = F.concat(F.slice(bits, 2, F.greatest(n - 1, F.lit(0))), F.slice(bits, 1, 1))
    places = F.sequence(F.lit(1), width)
    code_of = lambda a, b: F.array_join(F.transform(places, lambda i: F.when((i == a) | (i == b), "1").otherwise("0")), "")
    return F.when(n < 2, F.array().cast("array<string>")).when(n == 2, F.array(col(code))).otherwise(F.zip_with(bits, after, code_of))


def filler_for(length, fillers: dict[int, str], longest: str):
    """The filler sequence of a blocking oligo by its length; `longest` for all longer ones."""
    out = F.lit(longest)
    for size, seq in sorted(fillers.items(), reverse=True):
        out = F.when(col(length) == size, seq).otherwise(out)
    return out


def copies(bits, total: int = 15):
    """Rows per oligo: total / bits, rounded half to even, for codes of more than two bits, else total."""
    return F.when(col(bits) > 2, F.bround(F.lit(float(total)) / col(bits), 0).cast("int")).otherwise(F.lit(total))


def order_tier(length, limit: int = 60):
    """(amount, purification) of an order line by oligo length."""
    return F.when(col(length) <= limit, "25nm").otherwise("100nm"), F.when(col(length) <= limit, "STD").otherwise("PAGE")


def parse_number(name, prefix: str):
    """N of `prefix_N`; null where there is none."""
    found = F.regexp_extract(col(name), f"{prefix}_?([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def parse_probe_name(name):
    """level, target and number of `level_target_number` (target may hold underscores)."""
    parts = F.split(col(name), "_")
    n = F.size(parts)
    return F.element_at(parts, 1), F.array_join(F.slice(parts, 2, n - 2), "_"), F.element_at(parts, -1)


def probe_name(*parts):
    return F.concat_ws("_", *[col(p).cast("string") for p in parts])


def hamming(a, b):
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def error_class(distance):
    return F.when(col(distance) == 0, "correct").when(col(distance) == 1, "one").when(col(distance) == 2, "two").otherwise("more")


def parse_timestamp(c):
    """A time written as [yyyy-MM-ddTHH:mm:ss]."""
    return F.to_timestamp(col(c), "'['yyyy-MM-dd'T'HH:mm:ss']'")


# -- spectra -----------------------------------------------------------------------------------


def norm_max(v):
    """A spectrum over its largest value."""
    return bound(F.array_max(col(v)), lambda top: F.transform(col(v), lambda x: x / top))


def subtract_background(v, background, factor, channels: int = 32, absolute: bool = False):
    """The leading channels less factor times the background; the others as they are."""
    less = F.zip_with(F.slice(col(v), 1, channels), F.slice(col(background), 1, channels), lambda x, b: x - col(factor) * b)
    less = F.transform(less, F.abs) if absolute else less
    return F.concat(less, F.slice(col(v), channels + 1, F.greatest(F.size(col(v)) - channels, F.lit(0))))


def gate(v, channels: tuple[tuple[int, ...], ...], thresholds: tuple[float, ...]):
    """One flag per laser: 1 where any of its channels (0-based) is above its threshold."""
    return F.array(*[F.when(F.greatest(*[F.element_at(col(v), c + 1) for c in group]) > t, 1).otherwise(0) for group, t in zip(channels, thresholds)])


def peak_channel(v):
    """0-based channel of the (first) largest value."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def band_of(channel, edges: tuple[int, ...] = BANDS_63):
    """1-based band of a channel."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        out = F.when(col(channel) < edges[k], k).otherwise(out)
    return out


def cell_type(intensity, distance, area, touches, min_intensity: float = 0.1, max_distance: float = 0.02, max_area: float = 1000):
    return F.when(col(touches), "epithelia").when(col(area) > max_area, "debris").when((col(intensity) >= min_intensity) & (col(distance) <= max_distance), "cell").otherwise("other")


def snr(mean):
    """Shot-noise signal to noise."""
    return col(mean) / F.sqrt(col(mean))


def density(photons, area, photons_per_molecule: float, pixel: float, depth: float):
    """Molecules per volume from the photons of a region."""
    return col(photons) / photons_per_molecule / (col(area) * pixel * pixel * depth)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine distance; of two zero vectors 0, of one 1."""
    aa, bb = _dot(a, a), _dot(b, b)
    return F.when((aa == 0) & (bb == 0), 0.0).when((aa == 0) | (bb == 0), 1.0).otherwise(1 - _dot(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def _bands(v, edges):
    return [F.slice(col(v), a + 1, b - a) for a, b in zip(edges, edges[1:])]


def cosine_bands(a, b, edges: tuple[int, ...] = BANDS_63):
    """Mean cosine distance over all bands."""
    parts = [cosine(x, y) for x, y in zip(_bands(a, edges), _bands(b, edges))]
    return sum(parts[1:], parts[0]) / len(parts)


def band_cosine(a, b, flags_a, flags_b, edges: tuple[int, ...] = BANDS_63):
    """1 where the flags differ, or no band is active; else half the mean cosine distance of active bands."""
    active = [F.element_at(col(flags_a), k + 1) for k in range(len(edges) - 1)]
    n = sum(active[1:], active[0])
    parts = [F.when(on == 1, cosine(x, y)).otherwise(0.0) for on, x, y in zip(active, _bands(a, edges), _bands(b, edges))]
    return F.when((col(flags_a) != col(flags_b)) | (n == 0), 1.0).otherwise(0.5 * sum(parts[1:], parts[0]) / n)


def chi2_distance(a, b):
    """Sum of squared differences over sums; places with sum 0 count nothing."""
    terms = F.zip_with(col(a), col(b), lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / (x + y)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def correlation_distance(a, b):
    """1 less the Pearson correlation of two spectra."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v)
    centred = lambda v: bound(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return bound(centred(col(a)), lambda x: bound(centred(col(b)), lambda y: cosine(x, y)))


def channel_differences(v):
    n = F.size(col(v)) - 1
    return F.zip_with(F.slice(col(v), 2, n), F.slice(col(v), 1, n), lambda after, before: after - before)


def band_sums(v, edges: tuple[int, ...] = BANDS_63):
    """Running sums of a spectrum that start anew in each band."""
    empty = F.array().cast("array<double>")
    run = lambda band: F.aggregate(band, empty, lambda done, x: F.concat(done, F.array(x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)))))
    return F.concat(*[run(b) for b in _bands(v, edges)])


def line_distance(x, y, a: float, b: float, c: float):
    """Distance of a point to the line a x + b y + c = 0."""
    return F.abs(a * col(x) + b * col(y) + c) / (a * a + b * b) ** 0.5
