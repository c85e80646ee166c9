"""Chunks of the packing tokenizer: ids as by the tokenizer, and one entry for spellings that differ in case alone."""

import pyarrow as pa

from vellum.llm import packing


def test_case_makes_no_new_entries():
    path = packing.default_tokenizer()
    tok = packing.ChunkTokenizer(path, 1)
    texts = ["The the THE word, Word. Émile émile É. WORD&&& word&&&", "straße STRASSE ÅNGSTRÖM Ångström, İ i̇ Σας 12a A12", "", None, "áB Áb"]
    for _ in range(2):
        ids, ends, _ = tok.encode(pa.array(texts, pa.string()))
        want = [[*tok.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(want, []) and ends.tolist() == [sum(map(len, want[: k + 1])) for k in range(len(texts))]
    assert "the" in tok.entry and "The" not in tok.entry and "word&&&" in tok.entry and "WORD&&&" not in tok.entry
