"""Findings of the third round on the training-data operators."""

from luminode.llm import tokens


def test_token_counts_work_a_word_out_once(monkeypatch):
    """A word that meets pairs of pieces for the first time is not worked out again for them."""
    counter, worked_out = tokens.PrefixCounter(tokens.load_sentencepiece(tokens.VOCABULARY)), []
    extend = counter.extend
    monkeypatch.setattr(counter, "extend", lambda word, *rest: worked_out.append(word) or extend(word, *rest))
    texts = [" ".join(f"{a}zw{b}qvx{a}" for a in "abcdefgh") + " often 日本\U000f0000" for b in "klmnop"]
    tables = [counter.tables([t])[0] for t in texts]
    assert len(worked_out) == len(set(worked_out)) == 8 * 6 + 2
    for text, table in zip(texts, tables):
        assert tokens.counts(table)[-1] == len(counter.model.encode(text))
