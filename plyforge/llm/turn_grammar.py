"""Cheapest repairs of runs of turns: weighted parsing of spans with a grammar in Chomsky normal form.

A repaired conversation holds an optional system turn and then pairs of a user and an assistant turn. After any
of its turns it stands in one of four places (`START`, `SYSTEM`, `USER`, `REPLY`); a nonterminal is a pair of
places, and derives the turns that lead from the one to the other:

    (p, q) -> (p, r) (r, q)          for any place r between
    (p, q) -> one edited turn, and turns inserted behind it

The cell of a span holds the least (cost, audit) of each nonterminal; the audit has one letter per edit: K keep,
R give another role, D delete, I insert. As the place between two turns is all that the rest depends on, any cut
of a span leads to the same cell; spans are therefore halved, and cells are combined bottom-up by span length.
Of two audits of one cost neither begins with the other (the longer one would have insertions more, which cost),
so that the least of the joined audits is the least audits joined.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, REPLY = range(4)
PLACES = range(4)
ENDS = (START, REPLY)  # where a conversation may end
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", REPLY): USER, ("a", USER): REPLY}
RETOLD, DELETED, INSERTED, CUT_OFF = 1, 2, 5, 5  # costs of edits, and of keeping a truncated turn in any role
#: Letters of turns: the initial of the role (o: any other), in capitals if the text is cut off; x and y must go.
BLANK, REPEATED = "x", "y"
SPACES = " \t\n\x0b\x0c\r"
MEMORY = 1 << 14  # cells of short spans that a worker remembers

Cell = dict[tuple[int, int], tuple[int, str]]


def letter(role: str, text: str) -> str:
    """The letter of a turn, repeats left out of account."""
    end = text.rstrip(SPACES)[-1:]
    if not end:
        return BLANK
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if end in ".!?" else initial.upper()


def least(cells: list[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for pair, value in cells:
        if pair not in out or value < out[pair]:
            out[pair] = value
    return out


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans."""
    return least([((p, q), (a + b, x + y)) for (p, r), (a, x) in left.items() for (r2, q), (b, y) in right.items() if r == r2])


def _insertions() -> Cell:
    """The closure of inserting turns where there are none."""
    once = {(p, q): (INSERTED, "I") for (initial, p), q in NEXT.items() if initial != "s"}
    none = {(p, p): (0, "") for p in PLACES}
    closed: Cell = none
    while (longer := least([*none.items(), *joined(closed, once).items()])) != closed:
        closed = longer
    return closed


INSERTIONS = _insertions()


@lru_cache(MEMORY)
def span(letters: str) -> Cell:
    """The cell of a run of turns, each with the insertions behind it. Not to be changed by the caller."""
    if len(letters) > 1:
        half = len(letters) // 2
        return joined(span(letters[:half]), span(letters[half:])) if len(letters) <= 64 else _long_span(letters)
    edits = [((p, p), (DELETED, "D")) for p in PLACES]
    if letters not in (BLANK, REPEATED):
        more = CUT_OFF if letters.isupper() else 0
        for (initial, p), q in NEXT.items():
            if initial == letters.lower():
                edits.append(((p, q), (more, "K")))
            if initial != "s":
                edits.append(((p, q), (RETOLD + more, "R")))
    return joined(least(edits), INSERTIONS)


def _long_span(letters: str) -> Cell:
    """As `span`, bottom-up from pieces short enough to be remembered."""
    level = [span(letters[i:i + 64]) for i in range(0, len(letters), 64)]
    while len(level) > 1:
        level = [joined(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def paths(cells: list[Cell]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the cheapest repair of adjoining spans, and for each span the place it starts at and its
    audit; turns inserted before the first span are told with it. Cells are combined bottom-up, remembering
    where the best of each pair meets, and the choice is followed down again."""
    levels = [[INSERTIONS, *cells]]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([joined(*low[i:i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    (cost, _), end = min((levels[-1][0][START, q], q) for q in ENDS if (START, q) in levels[-1][0])
    ways = [(START, end)]
    for low, high in zip(reversed(levels[:-1]), reversed(levels[1:])):
        down = []
        for i, (p, q) in enumerate(ways):
            if 2 * i + 1 == len(low):
                down.append((p, q))
                continue
            a, b = low[2 * i], low[2 * i + 1]
            want = high[i][p, q]
            meets = next(r for r in PLACES if (p, r) in a and (r, q) in b and (a[p, r][0] + b[r, q][0], a[p, r][1] + b[r, q][1]) == want)
            down += [(p, meets), (meets, q)]
        ways = down
    told = [(way[0], cell[way][1]) for way, cell in zip(ways, levels[0])]
    if len(told) == 1:  # no turns at all
        return cost, []
    (_, before), (_, audit) = told[:2]
    return cost, [(START, before + audit), *told[2:]]


def repaired(roles: list[str], texts: list[str], place: int, audit: str) -> list[tuple[str, int | None, str, str]]:
    """(edit, number of the turn or None, role, text) of the turns that an audit leaves, from a place on."""
    out, i = [], 0
    for edit in audit:
        told = "assistant" if place == USER else "user"
        if edit == "I":
            out.append((edit, None, told, ""))
        else:
            if edit != "D":
                out.append((edit, i, roles[i] if edit == "K" else told, texts[i]))
            i += 1
        if edit != "D":
            place = NEXT[out[-1][2][:1], place]
    return out
