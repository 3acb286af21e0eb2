"""Running sums of arrays, in built-in functions."""

from __future__ import annotations

#: Elements that are summed up in one fold; a fold copies what it has so far at each step.
BLOCK = 256


def starts(sizes: str) -> str:
    """SQL for the sums before each element of an array of integers, which is an SQL expression itself.

    Folds run over blocks and over the blocks' sums, so that long arrays take nearly linear time.
    """
    fold = "aggregate({x}, named_struct('at', {at}, 'out', cast(array() as array<int>)), (s, n) -> named_struct('at', s.at + n, 'out', concat(s.out, array(s.at))), s -> s.out)"
    block = f"slice(sizes, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size(sizes) - 1) div {BLOCK})"
    sums = f"transform({blocks}, b -> aggregate({block}, 0, (s, n) -> s + n))"
    inner = f"transform(array({fold.format(x=sums, at='0')}), before -> flatten(transform({blocks}, b -> {fold.format(x=block, at='before[b]')})))[0]"
    return f"transform(array({sizes}), sizes -> if(size(sizes) = 0, cast(array() as array<int>), {inner}))[0]"
