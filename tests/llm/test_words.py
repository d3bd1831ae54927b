"""Words that a packing worker holds."""

from __future__ import annotations

import pyarrow as pa

from tidewire.llm import packing


def test_marks_take_no_entries_of_their_own():
    words = packing.WordIds(packing.vocabulary())
    texts = ["".join(f" stem{chr(97 + i)}{m}" for m in ("", "!", "***", "&&&", "%%%")) for i in range(9)]
    texts += ["  \t a ", "", "'s it's 'tis İst! (a.b) “q”! <|endoftext|>", "x\x1cy x\x85y"]
    # As a slice of a batch, which is what tasks hand on.
    found = words.of(pa.array(["before it", *texts, None], pa.string()).slice(1))
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in found] == [*want, []]
    assert sum(w.startswith(b"stem") for w in words) == 9
