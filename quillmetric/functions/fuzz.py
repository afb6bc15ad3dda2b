"""Fuzzy similarity of short strings, 0 to 100, by column functions alone.

All ratios rest on the longest common subsequence of two strings, found by a bit-parallel fold: one side is turned into bit masks per
letter (words of 62 bits, so that sums stay within a long), the letters of the other are folded over them. Words and windows of the masked side
are chosen by clearing the other bits, so one set of masks serves all ratios; wanted strings are parameters, and their masks are constants of
the plan. A count of common letters bounds all ratios: candidates are met in order of their bound, and a fold is left out where it cannot
change the result.

The expressions are written as SQL text: there are many small ones, and a text is parsed at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.functions.constants import constant
from quillmetric.functions.text import compute_once

W_SET, W_SORT, W_PART = 0.5, 0.3, 0.2
WORD_BITS = 62
FULL = f"{(1 << WORD_BITS) - 1}L"
_numbers = count()


def _names(n: int) -> list[str]:
    return [f"v{next(_numbers)}" for _ in range(n)]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, use: Callable[[str], str]) -> str:
    """Evaluate a value once and use it many times."""
    (x,) = _names(1)
    return f"get(transform(array({value}), {x} -> {use(x)}), 0)"


def _each(items: str, use: Callable[[str], str]) -> str:
    (x,) = _names(1)
    return f"transform({items}, {x} -> {use(x)})"


def _zip(a: str, b: str, use: Callable[[str, str], str]) -> str:
    x, y = _names(2)
    return f"zip_with({a}, {b}, ({x}, {y}) -> {use(x, y)})"


def _fold(items: str, start: str, step: Callable[[str, str], str], finish: Callable[[str], str] | None = None) -> str:
    held, x, end = _names(3)
    return f"aggregate({items}, {start}, ({held}, {x}) -> {step(held, x)}" + (f", {end} -> {finish(end)})" if finish else ")")


def _letters(text: str) -> str:
    return f"split({text}, '')"


def _joined(words: str) -> str:
    return f"array_join({words}, ' ')"


def _ratio(common: str, size: str) -> str:
    return f"(200D * {common} / ({size}))"


def plain(text: Column) -> Column:
    """Lower case, anything but letters and digits as blanks."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", " ")))


class _OneWord:
    """The fold over a string of at most 62 letters: the state is a long, in which each letter matched leaves a zero."""

    full = FULL

    def __init__(self, word: Callable[[str], str]) -> None:
        self.word = word

    def run(self, hits: str, only: str | None = None) -> str:
        if only is None:
            return _fold(hits, FULL, self.step)
        return _let(f"get({only}, 0)", lambda mask: _fold(hits, FULL, lambda v, m: self._next(v, f"({self.word(m)} & {mask})")))

    def step(self, v: str, m: str) -> str:
        return self._next(v, self.word(m))

    @staticmethod
    def _next(v: str, seen: str) -> str:
        # bits that are never seen stay one and let carries pass
        return f"(({v} + ({v} & {seen})) | ({v} & ~{seen})) & {FULL}"

    @staticmethod
    def matched(v: str) -> str:
        return f"({WORD_BITS} - bit_count({v}))"

    @staticmethod
    def matched_below(v: str, k: str) -> str:
        """What the first k letters of the string match."""
        return f"({k} - bit_count({v} & (shiftleft(1L, {k}) - 1L)))"

    def met(self, hits: str) -> str:
        return f"bit_count({_fold(hits, '0L', lambda held, m: f'{held} | {self.word(m)}')})"


class _ManyWords:
    """The same fold over a string of any length: the state is an array of words with carries from one to the next."""

    def __init__(self, n_words: str) -> None:
        self.full = f"array_repeat({FULL}, {n_words})"
        self.none = f"array_repeat(0L, {n_words})"
        self.places = f"sequence(0, {n_words} - 1)"

    def run(self, hits: str, only: str | None = None) -> str:
        if only is None:
            return _fold(hits, self.full, self.step)
        return _let(only, lambda mask: _fold(hits, self.full, lambda vs, ms: self.step(vs, _zip(ms, mask, "{} & {}".format))))

    def step(self, vs: str, ms: str) -> str:
        def add(state: str, w: str) -> str:
            def word(v: str, seen: str) -> str:
                return _let(f"{v} + ({v} & {seen}) + {state}.carry", lambda total: (
                    f"named_struct('words', array_append({state}.words, ({total} & {FULL}) | ({v} & ~{seen})), 'carry', shiftright({total}, {WORD_BITS}))"))

            return _let(f"named_struct('v', get({vs}, {w}), 'm', get({ms}, {w}))", lambda x: word(f"{x}.v", f"{x}.m"))

        return _fold(self.places, "named_struct('words', cast(array() as array<bigint>), 'carry', 0L)", add, lambda s: f"{s}.words")

    @staticmethod
    def matched(vs: str) -> str:
        return _fold(vs, "0", lambda n, v: f"{n} + {WORD_BITS} - bit_count({v})")

    def matched_below(self, vs: str, k: str) -> str:
        ones = _zip(vs, self.places, lambda v, w: f"bit_count({v} & {_span_word('0', k, w)})")
        return f"({k} - {_fold(ones, '0', '{} + {}'.format)})"

    def met(self, hits: str) -> str:
        every = _fold(hits, self.none, lambda held, ms: _zip(held, ms, "{} | {}".format))
        return _fold(every, "0", lambda n, v: f"{n} + bit_count({v})")


def _span_word(start: str, length: str, w: str) -> str:
    """Word ``w`` of the bits of a part of a string."""
    low, high = (f"greatest(0, least({WORD_BITS}, {at} - {w} * {WORD_BITS}))" for at in (start, f"{start} + {length}"))
    return f"shiftleft(shiftleft(1L, {high} - {low}) - 1L, {low})"


@dataclass(frozen=True)
class _Bits:
    """A string as bit masks per letter; ``one_word`` is None if that shows only row by row."""

    masks: str  # numbers if ``one_word``, else arrays of them
    n_words: str
    one_word: bool | None

    @classmethod
    def of(cls, text: str) -> _Bits:
        n = max(1, -(-len(text) // WORD_BITS))
        masks: dict[str, list[int]] = {}
        for i, letter in enumerate(text):
            masks.setdefault(letter, [0] * n)[i // WORD_BITS] |= 1 << i % WORD_BITS
        def value(words: list[int]) -> str:
            return f"{words[0]}L" if n == 1 else f"array({', '.join(f'{w}L' for w in words)})"

        entries = [f"{_quoted(letter)}, {value(words)}" for letter, words in masks.items()]
        return cls(f"map({', '.join(entries)})", str(n), n == 1)

    @classmethod
    def of_column(cls, text: str) -> _Bits:
        n_words = f"greatest(cast(ceil(char_length({text}) / {WORD_BITS}) as int), 1)"

        def word_of(letter: str, part: str) -> str:
            return _fold(f"sequence(0, size({part}) - 1)", "0L", lambda held, i: f"{held} | if(get({part}, {i}) = {letter}, shiftleft(1L, {i}), 0L)")

        def masks_of(letters: str) -> str:
            parts = _each(f"sequence(0, {n_words} - 1)", lambda w: f"slice({letters}, {w} * {WORD_BITS} + 1, {WORD_BITS})")
            return _let(parts, lambda ps: "map_from_entries(" + _each(
                f"array_distinct({letters})", lambda x: f"struct({x}, {_each(ps, lambda part: word_of(x, part))})") + ")")

        return cls(_let(_letters(text), masks_of), n_words, None)

    def hits(self, letters: str) -> str:
        """The masks of each letter of the other string."""
        none = "0L" if self.one_word else f"array_repeat(0L, {self.n_words})"
        return _each(letters, lambda x: f"coalesce(try_element_at({self.masks}, {x}), {none})")

    def span(self, start: str, length: str) -> str:
        """The bits of a part of the string, word by word."""
        if self.one_word:
            return f"array({_span_word(start, length, '0')})"
        return _each(f"sequence(0, {self.n_words} - 1)", lambda w: _span_word(start, length, w))

    def fold(self, use: Callable[[_OneWord | _ManyWords], str]) -> str:
        """An expression with the fold that fits the string's length."""
        if self.one_word:
            return use(_OneWord(lambda m: m))
        many = use(_ManyWords(self.n_words))
        return many if self.one_word is False else f"if({self.n_words} = 1, {use(_OneWord(lambda m: f'get({m}, 0)'))}, {many})"

    def common(self, hits: str, only: str | None = None) -> str:
        """Length of the longest common subsequence of the other string's letters and the string, or its bits in ``only``."""
        return self.fold(lambda ops: ops.matched(ops.run(hits, only)))

    def letters_met(self, hits: str) -> str:
        """How many letters of the string occur in the other one: a bound of any common subsequence."""
        return self.fold(lambda ops: ops.met(hits))


@dataclass(frozen=True)
class _Wanted:
    """One side of a comparison, ready to meet many others."""

    text: str
    size: str
    words: str  # distinct and sorted
    whole: _Bits
    back: _Bits  # the text from its end
    sorted: _Bits
    sorted_size: str
    own: _Bits  # the distinct sorted words, a blank before each
    spans: str  # of the words there

    @classmethod
    def of(cls, text: str) -> _Wanted:
        every = sorted(w for w in text.split(" ") if w)
        words = sorted(set(every))
        starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
        spans = [f"named_struct('word', {_quoted(w)}, 'start', {s}, 'length', {len(w) + 1})" for w, s in zip(words, starts)]
        return cls(_quoted(text), str(len(text)), f"array({', '.join(map(_quoted, words))})", _Bits.of(text), _Bits.of(text[::-1]),
                   _Bits.of(" ".join(every)), str(len(" ".join(every))), _Bits.of("".join(" " + w for w in words)), f"array({', '.join(spans)})")

    @classmethod
    def of_column(cls, side: str) -> _Wanted:
        spaced = f"concat_ws('', {_each(f'{side}.words', lambda w: f'''concat(' ', {w})''')})"
        start = "named_struct('at', 0, 'spans', cast(array() as array<struct<word: string, start: int, length: int>>))"
        spans = _fold(f"{side}.words", start, lambda s, w: (
            f"named_struct('at', {s}.at + char_length({w}) + 1, 'spans', array_append({s}.spans, "
            f"named_struct('word', {w}, 'start', {s}.at, 'length', char_length({w}) + 1)))"), lambda s: f"{s}.spans")
        return cls(f"{side}.text", f"char_length({side}.text)", f"{side}.words", _Bits.of_column(f"{side}.text"),
                   _Bits.of_column(f"reverse({side}.text)"), _Bits.of_column(f"{side}.sorted"), f"char_length({side}.sorted)", _Bits.of_column(spaced), spans)


def _side(text: str) -> str:
    """A string with its sorted words."""
    return _let(f"filter(split({text}, ' +'), w -> w <> '')", lambda words: (
        f"named_struct('text', {text}, 'sorted', {_joined(f'array_sort({words})')}, 'words', array_sort(array_distinct({words})))"))


def _own_words(a: _Wanted, p: str) -> str:
    """Common letters of both sides' own words, each with a blank before it but the first."""
    kept = f"filter({a.spans}, s -> NOT array_contains({p}.shared, s.word))"
    only = _fold(kept, f"array_repeat(0L, {a.own.n_words})", lambda held, s: _zip(held, a.own.span(f"{s}.start", f"{s}.length"), "{} | {}".format))
    letters = _letters(f"concat(' ', {_joined(f'{p}.own_b')})")
    return f"({a.own.common(a.own.hits(letters), only)} - 1)"


def _set_ratio(p: str, common: str) -> str:
    """Best ratio among the shared words and each side's shared-plus-own words; the shared words lead both longer strings."""
    left, right = f"({p}.n_shared + 1 + {p}.n_a)", f"({p}.n_shared + 1 + {p}.n_b)"
    return (f"CASE WHEN {p}.n_shared = 0 THEN {_ratio(common, f'{p}.n_a + {p}.n_b')} WHEN {p}.n_a = 0 OR {p}.n_b = 0 THEN 100D "
            f"ELSE greatest({_ratio(f'({p}.n_shared + 1 + {common})', f'{left} + {right}')}, {_ratio(f'{p}.n_shared', f'{p}.n_shared + {left}')}, "
            f"{_ratio(f'{p}.n_shared', f'{p}.n_shared + {right}')}) END")


def _windows(size: str, n_windows: str, most: str, common: Callable[[str], str]) -> str:
    """Best common length of all windows of ``size`` letters.

    One window further shares at most one letter more, so windows that cannot be better than the best so far are passed over.
    """
    def look(s: str, i: str) -> str:
        def after(found: str) -> str:
            return _let(f"greatest({s}.best, {found})", lambda best: (
                f"named_struct('best', {best}, 'next', if({best} >= {most}, {n_windows}, {i} + {best} - {found} + 1))"))

        return f"if({i} < {s}.next, {s}, {_let(common(i), after)})"

    return _fold(f"sequence(0, {n_windows} - 1)", "named_struct('best', 0, 'next', 0)", look, lambda s: f"{s}.best")


def _first_letters(bits: _Bits, hits: str, size: str) -> str:
    """Best ratio of a string of ``size`` letters against the first letters of the other one, fewer than it has itself."""
    def grown(ops: _OneWord | _ManyWords) -> str:
        def step(s: str, m: str) -> str:
            return _let(ops.step(f"{s}.state", m), lambda state: (
                f"named_struct('state', {state}, 'k', {s}.k + 1, 'best', greatest({s}.best, {_ratio(ops.matched(state), f'{size} + {s}.k + 1')}))"))

        return _fold(f"slice({hits}, 1, {size} - 1)", f"named_struct('state', {ops.full}, 'k', 0, 'best', 0D)", step, lambda s: f"{s}.best")

    return bits.fold(grown)


def _own_first_letters(bits: _Bits, hits: str) -> str:
    """Best ratio of the other string against the string's own first letters, fewer than the other one has."""
    n = f"size({hits})"
    return bits.fold(lambda ops: _let(ops.run(hits), lambda state: _fold(
        f"sequence({n} - 1, 0, -1)", "0D", lambda held, k: f"greatest({held}, {_ratio(ops.matched_below(state, k), f'{n} + {k}')})")))


def _part_ratio(a: _Wanted, p: str) -> str:
    """Best ratio of the shorter string against windows of the longer one, cut windows at both ends included.

    Of strings of equal length either may be the one that is cut; the better direction counts.
    """
    hits, n, m = f"{p}.hits", f"size({p}.hits)", a.size
    in_b = _windows(m, f"({n} - {m} + 1)", f"least({p}.met, {m})", lambda i: a.whole.common(f"slice({hits}, {i} + 1, {m})"))
    in_a = _windows(n, f"({m} - {n} + 1)", f"least({p}.met, {n})", lambda i: a.whole.common(hits, a.whole.span(i, n)))

    def best(back: str) -> str:
        cut_b = f"{_first_letters(a.whole, hits, m)}, {_first_letters(a.back, back, m)}"
        cut_a = f"{_own_first_letters(a.whole, hits)}, {_own_first_letters(a.back, back)}"
        return (f"CASE WHEN {m} < {n} THEN greatest({_ratio(in_b, f'{m} + {m}')}, {cut_b}) WHEN {m} > {n} THEN greatest({_ratio(in_a, f'{n} + {n}')}, {cut_a}) "
                f"ELSE greatest({_ratio(a.whole.common(hits), f'{n} + {n}')}, {cut_b}, {cut_a}) END")

    return (f"CASE WHEN contains({a.text}, {p}.text) OR contains({p}.text, {a.text}) THEN 100D "
            f"ELSE {_let(a.back.hits(_letters(f'reverse({p}.text)')), best)} END")


def _better(a: _Wanted, held: str, p: str, strict: bool) -> str:
    """The larger of ``held`` and the weighted blend of the three ratios; what cannot win is left out, from the bounds on.

    With ``strict``, a part match inside an unrelated word does not count.
    """
    ordered = _ratio(a.sorted.common(a.sorted.hits(_letters(f"{p}.sorted"))), f"{a.sorted_size} + char_length({p}.sorted)")

    def blend(whole: str, known: str) -> str:
        part = _part_ratio(a, p)
        if strict:
            apart = f"size(array_except({a.words}, split({p}.text, '[^\\\\p{{L}}\\\\p{{N}}_]+'))) > 0"
            part = _let(part, lambda x: f"if({x} > {whole} AND {apart}, {whole}, {x})")
        return f"if({known} + {W_PART}D * {p}.most <= {held}, {held}, greatest({held}, {known} + {W_PART}D * {part}))"

    whole = _let(f"if({p}.n_a = 0 OR {p}.n_b = 0, 0, {_own_words(a, p)})", lambda common: _set_ratio(p, common))
    exact = _let(whole, lambda w: _let(f"{W_SET}D * {w} + {W_SORT}D * {ordered}", lambda known: blend(w, known)))
    return f"if({p}.bound <= {held}, {held}, {exact})"


def _bound(a: _Wanted, p: str) -> str:
    """What the blend can be at most, by the letters met: sorted words and own words have no letters but those of the strings."""
    own = _ratio(f"least({p}.met, {p}.n_a, {p}.n_b)", f"{p}.n_a + {p}.n_b")
    ordered = _ratio(f"least({p}.met, {a.sorted_size}, char_length({p}.sorted))", f"{a.sorted_size} + char_length({p}.sorted)")
    return f"{W_SET}D * if({p}.n_shared > 0, 100D, {own}) + {W_SORT}D * {ordered} + {W_PART}D * {p}.most"


def _with_best(df: DataFrame, a: _Wanted, strict: bool) -> DataFrame:
    """Raise ``_best`` to the best blend of ``a`` with the ``_sides``. One layer of columns per step keeps each short to plan."""
    fields = ["text", "sorted", "words"]

    def layer(df: DataFrame, first: bool = False, **more: Callable[[str], str]) -> DataFrame:
        old = [lambda p, f=f: f"'{f}', {p}.{f}" for f in fields]
        new = [lambda p, name=name, use=use: f"'{name}', {use(p)}" for name, use in more.items()]
        pairs = _each("_sides" if len(fields) == 3 else "_pairs", lambda p: "named_struct(" + ", ".join(
            x(p) for x in (new + old if first else old + new)) + ")")
        fields.extend(more)
        return df.withColumn("_pairs", F.expr(pairs))

    df = layer(df, shared=lambda p: f"array_intersect({p}.words, {a.words})", hits=lambda p: a.whole.hits(_letters(f"{p}.text")))
    df = layer(df, own_b=lambda p: f"array_except({p}.words, {p}.shared)", n_shared=lambda p: f"char_length({_joined(f'{p}.shared')})",
               met=lambda p: a.whole.letters_met(f"{p}.hits"), shorter=lambda p: f"least({a.size}, size({p}.hits))")
    df = layer(df, n_a=lambda p: f"char_length({_joined(f'array_except({a.words}, {p}.shared)')})", n_b=lambda p: f"char_length({_joined(f'{p}.own_b')})",
               most=lambda p: _ratio(f"least({p}.met, {p}.shorter)", f"{p}.shorter + least({p}.met, {p}.shorter)"))
    df = layer(df, first=True, bound=lambda p: _bound(a, p))
    best = _fold("sort_array(_pairs, false)", "_best", lambda held, p: _better(a, held, p, strict))
    return df.withColumn("_best", F.expr(best)).drop("_pairs")


def _finished(df: DataFrame, out: str, score: Column, helpers: Sequence[str]) -> DataFrame:
    # behind a generator, so that a filter on the score does not compute it a second time
    return compute_once(df.drop(out), **{out: score}).drop(*helpers)


def _score(df: DataFrame, out: str, wanted: Sequence[str], candidates: Column, digits: int, strict: bool) -> DataFrame:
    """``out``: the best blend of any wanted string and any candidate, rounded; 0 without candidates."""
    known = F.filter(F.array_distinct(F.coalesce(candidates, F.array().cast("array<string>"))), lambda c: c != "")
    scored = df.withColumn("_known", known).withColumn("_sides", F.expr(_each("_known", _side))).withColumn("_best", F.lit(0.0))
    for text in wanted:
        scored = _with_best(scored, _Wanted.of(text), strict)
    return _finished(scored, out, F.bround("_best", digits), ["_known", "_sides", "_best"])


def with_similarity(df: DataFrame, out: str, left: Column, right: Column) -> DataFrame:
    """Blended similarity of two string columns; 0 if either has no letter or digit."""
    ready = df.withColumn("_left", plain(F.coalesce(left, F.lit("")))).withColumn("_right", plain(F.coalesce(right, F.lit(""))))
    sides = ready.withColumn("_sides", F.expr(f"if(_left <> '' AND _right <> '', array({_side('_right')}), array())"))
    sides = sides.withColumn("_left", F.expr(_side("_left"))).withColumn("_best", F.lit(0.0))
    a = _Wanted.of_column("_left")
    parts = {"_whole": a.whole.masks, "_back": a.back.masks, "_sorted": a.sorted.masks, "_own": a.own.masks, "_spans": a.spans}
    sides = compute_once(sides, **{name: F.expr(sql) for name, sql in parts.items()})
    a = replace(a, spans="_spans", whole=replace(a.whole, masks="_whole"), back=replace(a.back, masks="_back"),
                sorted=replace(a.sorted, masks="_sorted"), own=replace(a.own, masks="_own"))
    return _finished(_with_best(sides, a, False), out, F.col("_best"), ["_left", "_right", "_sides", "_best", *parts])


def with_best_similarity(df: DataFrame, out: str, targets: Sequence[str], candidates: Column, digits: int = 2) -> DataFrame:
    """Best blended similarity between a parameter list and an array column, rounded; 0 for an empty array."""
    named = [t for t in targets if t and t.strip()]
    wanted = constant(F.array_distinct(F.transform(F.array(*map(F.lit, named)), plain))) if named else []
    return _score(df, out, [t for t in wanted if t], F.transform(candidates, plain), digits, False)


def with_best_company_similarity(df: DataFrame, out: str, target_key: str, candidate_keys: Column, digits: int = 2) -> DataFrame:
    """Best similarity of one cleaned company and an array of cleaned candidates, rounded; equal ones give 100."""
    return _score(df, out, [target_key] if target_key else [], candidate_keys, digits, True)
