"""Classes of words by the exchange method, over counts of classes that follow each other.

The clustering maximises the likelihood of a class bigram model, which up to a
constant is ``sum f(m) - sum f(row sums) - sum f(column sums)`` with
``f(x) = x log x`` over the matrix ``m`` of class pairs.  A word's move changes
one row and one column, so the best class for it, all else unchanged, follows
from its own counts: how often each class stands before it, after it, and how
often it follows itself.
"""

from __future__ import annotations

import numpy as np

#: Words that move at once, and counts below which their effect is tabulated.
STEP, SMALL = 256, 9


def f(x):
    """x log x for whole numbers, and 0 at 0."""
    x = np.asarray(x, np.float64)
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """What the exchange maximises."""
    return float(f(m).sum() - f(m.sum(axis=0)).sum() - f(m.sum(axis=1)).sum())


def _added(m: np.ndarray, fm: np.ndarray, counts: np.ndarray, count: int) -> np.ndarray:
    """[w, b]: what adding row w of ``counts`` to column b of ``m`` (below ``count``) changes the sum of f by."""
    word, c = np.nonzero(counts)
    out = np.zeros((len(counts), count))
    if len(word):
        n = counts[word, c]
        # most counts are small: what they change is worked out once for all words
        change = (f(m[:, :count] + np.arange(SMALL)[:, None, None]) - fm[:, :count])[np.minimum(n, SMALL - 1).astype(np.int64), c]
        large = np.flatnonzero(n >= SMALL)
        change[large] = f(m[c[large], :count] + n[large, None]) - fm[c[large], :count]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(change, first)
    return out


def _gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: np.ndarray, m: np.ndarray,
           count: int) -> np.ndarray:
    """[w, b]: the likelihood with word w in class b, less a number of w's own; all other words stay."""
    fm, rows, cols = f(m), m.sum(axis=1), m.sum(axis=0)
    w, d = np.arange(len(left)), np.arange(count)
    n_left, n_right = left.sum(axis=1) + own, right.sum(axis=1) + own
    gain = _added(m, fm, left, count) + _added(m.T, fm.T, right, count)
    # Where two sums change one cell: class b beside itself, and the class the word is leaving beside b.
    both = m[d, d]
    gain += (f(both + left[:, :count] + right[:, :count] + own[:, None]) - f(both + left[:, :count])
             - f(both + right[:, :count]) + fm[d, d])
    for near, far, cells in ((left, right, m), (right, left, m.T)):
        here, mine, gone = cells[classes, :count], near[w, classes][:, None], far[:, :count]
        gain += f(here - gone + mine) - f(here - gone) - f(here + mine) + f(here)
    gain -= f(rows[:count] + n_right[:, None]) - f(rows[:count]) + f(cols[:count] + n_left[:, None]) - f(cols[:count])
    # Staying: what the word's removal from its class would lose.
    stay = np.zeros(len(left))
    for counts, cells in ((left, m.T[classes]), (right, m[classes])):
        lost = f(cells) - f(cells - counts)
        lost[w, classes] = 0
        stay += lost.sum(axis=1)
    home = m[classes, classes]
    stay += f(home) - f(home - left[w, classes] - right[w, classes] - own)
    stay -= f(rows[classes]) - f(rows[classes] - n_right) + f(cols[classes]) - f(cols[classes] - n_left)
    gain[w, classes] = stay
    return gain


def exchange(before: np.ndarray, after: np.ndarray, own: np.ndarray, classes: np.ndarray, pairs: np.ndarray,
             count: int) -> np.ndarray:
    """New classes (below ``count``) of some words, each moved to the best class for it.

    ``before`` and ``after``: counts by class of the words' neighbours other than
    the word itself; ``own``: how often each follows itself; ``pairs``: the
    matrix of class pairs of the whole corpus.  Words move in steps of ``STEP``,
    which see the moves of the steps before.  Ties stay, then go to the lower class.
    """
    m = pairs.astype(np.float64)
    out = classes.copy()
    for at in range(0, len(out), STEP):
        part = slice(at, at + STEP)
        left, right, own_ = (x[part].astype(np.float64) for x in (before, after, own))
        a = out[part].astype(np.int64)
        gain = _gains(left, right, own_, a, m, count)
        best = np.argmax(gain, axis=1)
        w = np.arange(len(a))
        now = gain[w, a]
        b = np.where(gain[w, best] > now + 1e-9 * np.abs(now), best, a)
        move = np.zeros((len(a), len(m)))
        move[w, b] += 1
        move[w, a] -= 1
        m += left.T @ move + move.T @ right
        m += np.diag(own_ @ move)
        np.maximum(m, 0, out=m)  # neighbours that moved in one step are counted in their old classes
        out[part] = b
    return out


def assigned(word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, pairs: np.ndarray, count: int) -> np.ndarray:
    """Classes of words that are in none yet, each by one exchange against ``pairs``.

    Entries (``word``, ``code``, ``n``), ascending by word: the word stands ``n`` times after
    class ``code // k`` and before class ``code % k``, with k the side of ``pairs``.
    """
    k = len(pairs)
    m = pairs.astype(np.float64)
    gain = np.zeros((words, count))
    left, right = np.divmod(code, k)
    for times in np.unique(n):
        # One table per multiplicity: what ``times`` more pairs add to each cell.
        table = f(m + times) - f(m)
        at = np.flatnonzero(n == times)
        np.add.at(gain, word[at], table[left[at], :count] + table[:count].T[right[at]])
    total = np.bincount(word, n, words)[:, None]
    rows, cols = m.sum(axis=1)[:count], m.sum(axis=0)[:count]
    gain -= f(rows + total) - f(rows) + f(cols + total) - f(cols)
    return np.argmax(gain, axis=1).astype(np.uint8)
