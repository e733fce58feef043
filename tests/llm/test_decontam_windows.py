"""Only windows that can pass the verification are fingerprinted."""

from __future__ import annotations

import random

from wareflow.llm import decontam


def test_windows_of_other_lengths_are_not_looked_up(monkeypatch):
    rng = random.Random(2)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(n, " ".join(draw(n))) for n in range(15, 60)]
    text = " ".join([*draw(300), items[-1][1], *draw(300), *items[0][1].split()[:9], *draw(300)])
    looked_up, within = [], decontam.Items.within

    def counted(self, prints):
        looked_up.append(len(prints))
        return within(self, prints)

    monkeypatch.setattr(decontam.Items, "within", counted)
    found = decontam.Items.of(items).matches(text, 80)
    assert found == {44: (1.0, 300, 59)}
    # Of the item's length, and no more than a tenth of its shingles off.
    assert len(looked_up) == 1 and sum(looked_up) <= 15, looked_up
