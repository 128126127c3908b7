"""Problem 1: answers that are no usable answer to their prompt, by a conditional random field over clauses.

Responses are parted into clauses; each gets the share of its word pairs that stand in the prompt, the evidence that its
language is neither that of the prompt's first sentence nor one the prompt asks for, the probability that the text ends
unfinished (last clause), and hashed words and word pairs. A linear-chain conditional random field tags clauses as
answer, refusal, echo, foreign or unfinished; the tags' coverage of the response decides the pair's defect:

    empty           null, blank or a bare placeholder (a rule)
    refusal         refusing clauses cover REFUSED of the text or more
    copy            echo covers COPIED of the text or more and ECHOED of the prompt's word pairs are in it
    other_language  all but unfinished clauses are foreign
    truncated       the last clause is unfinished

A pair has the first that applies. A null or blank prompt has no language and cannot be copied. Training pairs are made
from a sample of at most MAX_TRAIN pairs (the first by the hash of their key) by recombination: answers kept, prompts echoed
whole or in part, answers of other prompts in other languages, refusals put together by a grammar (refusals.py), and answers
cut short. A first fit then looks for refusals, however worded, among at most MAX_MINED sampled pairs; these are refusals of
the second fit.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm import refusals as seeds
from millrace.llm import truncation as cut_off
from millrace.llm.language import CODES, NOTATIONS, PLACEHOLDERS, Model, bounded_sample, labelled, viterbi
from millrace.llm.sentences import sentence_offsets
from millrace.llm.visual_form import normalise, plain_of_form

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
WORDED = [REFUSAL, ECHO]  # the tags that words speak for or against
DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")
EMPTY = 0
MAX_TRAIN = 2_500
MAX_MINED = 10_000
MAX_SAID = 1_000  # language samples among the training pairs
ROUNDS = 2
BITS = 14
N_DENSE = 14
REFUSED, COPIED, ECHOED = 0.4, 0.75, 0.5

_NAMES = {name: row.split()[0] for row in NOTATIONS.strip().split("\n") for name in row.split() if len(name) > 3 or ord(name[0]) > 0x2E80}
_ASKED = re.compile(r"(?i)\b(?:in|into|en|auf|em|na|на|по|بال|用)[ -]?(?:plain |the )?(" + "|".join(sorted(map(re.escape, _NAMES), key=len, reverse=True)) + r")")


def asked_languages(prompt: str, codes: tuple[str, ...] = CODES) -> list[int]:
    """Languages of ``codes`` that a prompt names as that of the answer."""
    named = (_NAMES.get(m.lower()) for m in _ASKED.findall(prompt))
    return [codes.index(c) for c in named if c in codes]


class Clauses:
    """A batch of responses as clauses with their features."""

    def __init__(self, lang: Model, cut: np.ndarray, responses: pa.Array, prompts: pa.Array, which: np.ndarray):
        cps, offs = normalise(*cp.flatten(responses))
        starts, self.first = sentence_offsets(cps, offs)
        pc, po = plain_of_form(cps, starts)
        n_rows, n = len(offs) - 1, len(starts) - 1
        self.row = np.repeat(np.arange(n_rows), np.diff(self.first))
        self.size = np.diff(po)
        words, woffs, _ = cp.word_hashes(pc, po)
        pairs, paoffs = cp.sequence_hashes(words, woffs, 2)
        n_words = np.diff(woffs)

        qc, qo = normalise(*cp.flatten(prompts))
        qstarts, qfirst = sentence_offsets(qc, qo)
        qpc, qpo = plain_of_form(qc, qstarts)
        qwords, qwoffs, _ = cp.word_hashes(qpc, qpo)
        qpairs, qpaoffs = cp.sequence_hashes(qwords, qwoffs, 2)
        per_prompt = qpaoffs[qfirst]
        salt = cp.mix64(np.arange(len(prompts), dtype=np.uint64) + np.uint64(99))
        keys = np.unique(qpairs + np.repeat(salt, np.diff(per_prompt)))
        self.prompt_pairs = np.bincount(np.repeat(np.arange(len(prompts)), np.diff(per_prompt)), minlength=len(prompts))[which]
        per_row = np.diff(paoffs[self.first])
        asked = pairs + np.repeat(salt[which], per_row)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
        else:
            hit = np.zeros(len(asked), bool)
        hits = _sums(hit.astype(np.int64), paoffs)
        n_pairs = np.diff(paoffs)
        echo = hits / np.maximum(n_pairs, 1)
        self.echoed = np.bincount(self.row, hits, n_rows)

        like = lang.scores(pc, po)
        allowed = self._allowed(lang, qpc, qpo, qfirst, prompts)[which]
        ok = allowed[self.row]
        inside = np.where(ok, like, -1e9).max(1)
        outside = np.where(ok, -1e9, like).max(1)
        foreign = np.where((n_words > 1) & ~ok.all(1), np.clip(outside - inside, -12, 12), 0)

        self.spoken = ~ok.all(1)  # whether the prompt has a language at all
        none = np.full(n_rows, -1)
        xf = cut_off.features(cps, offs, none, none)
        logit = np.clip(cut[xf].sum(1) + cut[-1], -8, 8)
        last = np.zeros(n, bool)
        some = np.diff(self.first) > 0
        last[self.first[1:][some] - 1] = True
        begin = np.zeros(n, bool)
        begin[self.first[:-1][some]] = True
        by_last = np.where(last, logit[self.row], 0)
        d = [np.ones(n), echo, echo > 0.95, echo > 0.5, foreign / 6, foreign > 1.5, foreign < -1.5, last, by_last / 4, last & (by_last > 0), last & (by_last < 0), begin, np.log1p(n_words) / 3, n_words == 1]
        self.dense = np.stack(d, 1).astype(np.float32)
        shift = np.uint64(64 - BITS)
        self.hashed = np.concatenate([(cp.mix64(words) >> shift), (cp.mix64(pairs + np.uint64(5)) >> shift)]).astype(np.int32)
        self.woffs, self.paoffs = woffs, paoffs

    @staticmethod
    def _allowed(lang: Model, qpc: np.ndarray, qpo: np.ndarray, qfirst: np.ndarray, prompts: pa.Array) -> np.ndarray:
        """Languages an answer to each prompt may have: that of its first sentence of more than one word, and those asked for."""
        n = len(qfirst) - 1
        many = np.diff(cp.word_hashes(qpc, qpo)[1]) > 1
        at = np.flatnonzero(many)
        row = np.repeat(np.arange(n), np.diff(qfirst))
        _, head = np.unique(row[at], return_index=True)
        head = at[head]
        out = np.zeros((n, len(lang.codes)), bool)
        if len(head):
            size = np.diff(qpo)[head]
            take = np.repeat(qpo[head], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[row[head], lang.scores(qpc[take], np.concatenate([[0], np.cumsum(size)])).argmax(1)] = True
        for i, text in enumerate(prompts.to_pylist()):
            for code in asked_languages(text or "", lang.codes):
                out[i, code] = True
        out[~out.any(1)] = True
        return out

    def emissions(self, w: dict[str, np.ndarray]) -> np.ndarray:
        n_words = self.woffs[-1]
        out = self.dense @ w["dense"]
        by_word = (_sums(w["hashed"][self.hashed[:n_words]], self.woffs) + _sums(w["hashed"][self.hashed[n_words:]], self.paoffs)) / 2
        out[:, WORDED] += by_word  # foreign and unfinished clauses have the words of an answer
        out[:, UNFINISHED] = np.where(self.dense[:, 7] > 0, out[:, UNFINISHED], -30)
        out[:, FOREIGN] = np.where(self.spoken, out[:, FOREIGN], -30)
        some = np.diff(self.first) > 0
        out[self.first[:-1][some]] += w["start"]
        return out

    def defects(self, tags: np.ndarray) -> np.ndarray:
        """Defect of each response by the coverage of its tags (index into DEFECTS, -1: none)."""
        n = len(self.first) - 1
        size = np.maximum(self.size, 1e-3)
        total = np.bincount(self.row, size, n)
        share = [np.bincount(self.row, size * (tags == t), n) / np.maximum(total, 1e-9) for t in range(len(TAGS))]
        last = np.full(n, -1)
        some = np.diff(self.first) > 0
        last[some] = tags[self.first[1:][some] - 1]
        copied = (share[ECHO] >= COPIED) & (self.echoed >= ECHOED * self.prompt_pairs)
        foreign = (share[FOREIGN] > 0) & (share[FOREIGN] + share[UNFINISHED] >= 0.98)
        out = np.full(n, -1)
        for code, flag in ((4, last == UNFINISHED), (3, foreign), (2, copied), (1, share[REFUSAL] >= REFUSED)):
            out[flag] = code
        out[total == 0] = -1
        return out


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offs) - 1, *values.shape[1:]), values.dtype)
    some = np.diff(offs) > 0
    if some.any():
        out[some] = np.add.reduceat(values, offs[:-1][some], axis=0)
    return out


def fit_crf(c: Clauses, tags: np.ndarray, rounds: int = 60, rate: float = 0.15, l2: float = 2e-4) -> dict[str, np.ndarray]:
    """Maximum likelihood of the tag sequences by forward-backward and Adam."""
    k = len(TAGS)
    w = {"dense": np.zeros((N_DENSE, k), np.float32), "hashed": np.zeros((1 << BITS, len(WORDED)), np.float32), "start": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32)}
    m, v = ({key: np.zeros_like(x) for key, x in w.items()} for _ in range(2))
    first, lens = c.first, np.diff(c.first)
    n_rows, top = len(lens), int(lens.max(initial=0))
    slot = np.arange(len(tags)) - np.repeat(first[:-1], lens)
    some = lens > 0
    owner = np.concatenate([np.repeat(np.arange(len(tags)), np.diff(c.woffs)), np.repeat(np.arange(len(tags)), np.diff(c.paoffs))])
    onehot = np.eye(k, dtype=np.float32)[tags]
    follows = np.flatnonzero(slot > 0)
    gold_move = np.zeros((k, k))
    np.add.at(gold_move, (tags[follows - 1], tags[follows]), 1)
    by_time = [first[:-1][lens > t] + t for t in range(top)]
    ends = first[1:][some] - 1
    for step in range(1, rounds + 1):
        # forward and backward in probabilities, each position scaled to a sum of one
        e = c.emissions(w).astype(np.float64)
        e = np.exp(e - e.max(1, keepdims=True))
        move = np.exp(w["move"].astype(np.float64))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        for t, at in enumerate(by_time):
            x = e[at] * (alpha[at - 1] @ move) if t else e[at]
            alpha[at] = x / x.sum(1, keepdims=True)
        beta[ends] = 1 / k
        for t in range(top - 2, -1, -1):
            at = by_time[t + 1] - 1
            x = (e[at + 1] * beta[at + 1]) @ move.T
            beta[at] = x / x.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(1, keepdims=True)
        diff = ((post - onehot) / n_rows).astype(np.float32)
        left, right = alpha[follows - 1], e[follows] * beta[follows]
        weight = 1 / np.einsum("ni,ij,nj->n", left, move, right)
        both = (left * weight[:, None]).T @ right * move
        g = {"dense": c.dense.T @ diff, "start": diff[first[:-1][some]].sum(0), "move": ((both - gold_move) / n_rows).astype(np.float32)}
        g["hashed"] = np.stack([np.bincount(c.hashed, diff[owner, j] / 2, 1 << BITS) for j in WORDED], 1).astype(np.float32)
        for key in w:
            g[key] += l2 * w[key] * (1 if key == "hashed" else 0.5)
            m[key] = 0.9 * m[key] + 0.1 * g[key]
            v[key] = 0.99 * v[key] + 0.01 * g[key] ** 2
            w[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-7)
    return w


def _fill(rng: np.random.Generator, text: str) -> str:
    pick = lambda xs: xs[rng.integers(len(xs))]
    return text.format(k=pick(seeds.KINDS), n=pick(seeds.NOUNS), a=pick(seeds.ADJECTIVES), x=pick(seeds.NAMES))


def sentences_of(texts: list[str]) -> list[list[str]]:
    """The sentences of each text, without empty ones."""
    cps, offs = cp.from_texts(texts)
    starts, first = sentence_offsets(cps, offs)
    flat = cp.texts_of(cps, starts) if len(cps) else []
    return [[s for s in flat[a:b] if s] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def training_pairs(pairs: list[tuple[str, str]], lang: Model, samples: list[tuple[str, str]] = (), learnt: list[tuple[str, list[tuple[str, int]]]] = (), seed: int = 23) -> list[tuple[str, list[tuple[str, int]]]]:
    """(prompt, [(clause, tag)]) examples recombined from sampled pairs and the grammar of refusals; ``learnt`` are pairs
    whose refusing clauses an earlier round has found: they serve as refusals, and no longer as answers. ``samples`` (text,
    language) serve as answers in another language."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    from millrace.llm.visual_form import plain

    code = lambda texts: lang.scores(*plain(*cp.from_texts(texts))).argmax(1)
    known = {x for p, r in learnt for x in ((p, "".join(s for s, _ in r)),)}
    declines = {h for c in CODES for x in pairs_of(seeds.phrases(c)) for h in x}
    share = lambda have, of: sum(h in of for h in have) / max(len(have), 1)
    kept, lp, lr = [], [], []
    parts, prompt_parts = sentences_of([r for _, r in pairs]), sentences_of([p for p, _ in pairs])
    prompt_lang = code([(x or [""])[0] for x in prompt_parts])
    answer_lang = code([r for _, r in pairs])
    whole = cut_off.looks_complete([r for _, r in pairs])
    said, asked_for = pairs_of([r for _, r in pairs]), pairs_of([p for p, _ in pairs])
    clause_pairs = iter(pairs_of([s for x in parts for s in x[:4]]))
    heads = [[next(clause_pairs) for _ in x[:4]] for x in parts]
    for i, (p, r) in enumerate(pairs):
        if not whole[i] or not said[i] or (p, r) in known or share(said[i], set(asked_for[i])) > 0.5:
            continue
        if share(said[i], declines) > 0.25 or any(share(s, declines) >= 0.4 for s in heads[i]):
            continue
        if answer_lang[i] == prompt_lang[i] or answer_lang[i] in asked_languages(p, lang.codes):
            kept.append((p, parts[i], prompt_parts[i]))
            lp.append(prompt_lang[i])
            lr.append(answer_lang[i])
    out: list[tuple[str, list[tuple[str, int]]]] = [x for x in learnt for _ in range(4)]
    by_lang: dict[int, list[int]] = {}
    for i, x in enumerate(lr):
        by_lang.setdefault(int(x), []).append(i)

    def refusal(say: str) -> list[tuple[str, int]]:
        text = [(_fill(rng, s) + " ", REFUSAL) for s in seeds.decline(rng, say)]
        if rng.random() < 0.4:
            text.insert(0, (_fill(rng, pick(seeds.LEAD[say].split("|"))) + " ", REFUSAL))
        if rng.random() < 0.4:
            text.append((_fill(rng, pick(seeds.TRAIL[say].split("|"))), REFUSAL))
        return text

    for i, (p, r, ps) in enumerate(kept):
        own = lang.codes[lp[i]]
        ans = [(s, ANSWER) for s in r]
        asked = set(asked_languages(p, lang.codes)) | {int(lp[i])}
        out.append((p, ans))
        if rng.random() < 0.15:
            at = int(rng.integers(len(ans) + 1))
            out.append((p, ans[:at] + [(_fill(rng, pick(seeds.SOUNDS_LIKE.split("|"))) + " ", ANSWER)] + ans[at:]))
        if rng.random() < 0.3:  # short answers, some with a refusal's words
            out.append((p, ans[:1]))
        if rng.random() < 0.25:
            short = [(_fill(rng, pick(seeds.PLAIN.split("|"))) + " ", ANSWER)]
            out.append((p, short if rng.random() < 0.5 else [*short, *ans[:2]]))
        if rng.random() < 0.1:
            out.append((p, [(_fill(rng, pick(seeds.LEAD["en"].split("|"))) + " ", ANSWER), *ans]))
        if rng.random() < 0.35 or own != "en":
            out.append((p, refusal(own if own in CODES and rng.random() < 0.8 else pick(CODES))))
        how = rng.random()
        if how < 0.2:  # the prompt whole, or most of it
            echo = [(s, ECHO) for s in ps if how < 0.1 or rng.random() < 0.85] or [(ps[0], ECHO)]
            if rng.random() < 0.4:
                echo[-1] = (echo[-1][0].rstrip() + "\n", ECHO)
                echo.append((pick(seeds.ASIDE), ECHO))
            out.append((p, echo))
        elif how < 0.4:  # its beginning, then an answer
            out.append((p, [(s.rstrip() + " ", ECHO) for s in ps[: int(rng.integers(1, 3))]] + ans))
        elif how < 0.6 and len(by_lang) > 1:  # another language
            other = [x for x in by_lang if x not in asked]
            if other:
                r2 = kept[pick(by_lang[pick(other)])][1]
                if rng.random() < 0.2 and len(ans) > 1:
                    out.append((p, [*ans[:-1], (r2[0].rstrip() + " ", FOREIGN), ans[-1]]))
                else:
                    out.append((p, [(s, FOREIGN) for s in r2]))
        elif how < 0.9:  # cut short
            text, _, y = cut_off.cut_examples(["".join(r)], [(0, 0)], int(rng.integers(1 << 30)))
            if len(y) > 1:
                s = sentences_of([text[1]])[0]
                out.append((p, [(x, ANSWER) for x in s[:-1]] + [(s[-1], UNFINISHED)]))
    if kept:  # refusals of every language, whatever languages the sample has
        for say in CODES:
            for _ in range(min(500, len(kept)) if say == "en" else min(250, 30 + len(kept) // 2)):
                out.append((kept[int(rng.integers(len(kept)))][0], refusal(say)))
        # and texts of every language that refuse nothing: answers where the prompt has their language, else foreign
        said_in: dict[str, list[int]] = {}
        for i, x in enumerate(lp):
            said_in.setdefault(lang.codes[x], []).append(i)
        order = rng.permutation(len(samples))[:MAX_SAID]
        for text, say in zip(sentences_of([samples[i][0] for i in order]), (samples[i][1] for i in order)):
            for i in (int(rng.integers(len(kept))), *([pick(said_in[say])] if say in said_in else [])):
                allowed = say in lang.codes and lang.codes.index(say) in (lp[i], *asked_languages(kept[i][0], lang.codes))
                out.append((kept[i][0], [(s, ANSWER if allowed else FOREIGN) for s in text[: int(rng.integers(1, 4))]]))
    return out


def pairs_of(texts: list[str]) -> list[list[int]]:
    """Hashes of the word pairs of each text."""
    from millrace.llm.visual_form import plain

    words, offs, _ = cp.word_hashes(*plain(*cp.from_texts(texts)))
    pairs, at = cp.sequence_hashes(words, offs, 2)
    pairs = pairs.tolist()
    return [pairs[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _fitted(made: list[tuple[str, list[tuple[str, int]]]], lang: Model, cut: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    """The random field of tagged examples."""
    responses = pa.array(["".join(s for s, _ in x) for _, x in made], pa.large_string())
    prompts = pa.array([p for p, _ in made], pa.large_string()).dictionary_encode()
    c = Clauses(lang, cut, responses, prompts.dictionary, prompts.indices.to_numpy())
    # clauses found in the joined text take the tag of the piece that holds their middle
    cps, offs = normalise(*cp.flatten(responses))
    starts, first = sentence_offsets(cps, offs)
    sizes = np.array([len(x) for _, x in made])
    piece_offs = normalise(*cp.from_texts([s for _, x in made for s, _ in x]))[1]
    piece_tags = np.array([t for _, x in made for _, t in x])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(made)), np.diff(first))
    middle = (starts[:-1] + starts[1:]) / 2 - offs[row] + piece_offs[begin[row]]
    at = np.searchsorted(piece_offs, middle, "right") - 1
    tags = piece_tags[np.clip(at, begin[row], begin[row + 1] - 1)]
    last = np.zeros(len(tags), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    tags[(tags == UNFINISHED) & ~last] = ANSWER
    return fit_crf(c, tags, rounds)


def refusals_in(model: dict, pairs: list[tuple[str, str]]) -> list[tuple[str, list[tuple[str, int]]]]:
    """The pairs a model takes to be refusals, as tagged examples."""
    responses, prompts = pa.array([r for _, r in pairs], pa.large_string()), pa.array([p for p, _ in pairs], pa.large_string())
    c, tags = tag(model, responses, prompts)
    out = []
    hit = np.flatnonzero(c.defects(tags) == DEFECTS.index("refusal"))
    for i, text in zip(hit, sentences_of([pairs[i][1] for i in hit])):
        mine = tags[c.first[i] : c.first[i + 1]]
        if len(text) == len(mine):
            out.append((pairs[i][0], [(s, int(t) if t in (REFUSAL, ANSWER) else REFUSAL) for s, t in zip(text, mine)]))
    return out


def train(pairs: list[tuple[str, str]], lang: Model, samples: list[tuple[str, str]] = ()) -> dict:
    """The tagger: language model, unfinished-ending weights and random-field weights.

    Fitted ROUNDS times: the refusals that a round finds among the sampled pairs, worded as they may be, are refusals of
    the next, so that their words are learnt from the data.
    """
    base = pairs[:MAX_TRAIN]
    cut = cut_off.train([r for _, r in base], [(0, 0)] * len(base))
    learnt: list = []
    for k in range(ROUNDS):
        if k:
            learnt = refusals_in(model, pairs)
        model = {"lang": lang, "cut": cut, "crf": _fitted(training_pairs(base, lang, samples, learnt), lang, cut, 60 if k + 1 == ROUNDS else 35)}
    return model


@functools.cache
def _loaded(blob: bytes) -> dict:
    return pickle.loads(blob)


@functools.lru_cache(4)
def _trained(pairs: tuple[tuple[str, str], ...], samples: tuple[tuple[str, str], ...]) -> bytes:
    """The tagger of a sample, pickled; kept for the next call with the same sample."""
    lang = Model.train([t for t, _ in samples], [c for _, c in samples], orders=(3,))
    return pickle.dumps(train(list(pairs), lang, list(samples)))


def tag(model: dict, responses: pa.Array, prompts: pa.Array) -> tuple[Clauses, np.ndarray]:
    """Clauses of responses and their tags; prompts that recur in the batch are looked at once."""
    coded = prompts.cast(pa.large_string()).fill_null("").dictionary_encode()
    c = Clauses(model["lang"], model["cut"], responses, coded.dictionary, coded.indices.to_numpy())
    return c, viterbi(c.emissions(model["crf"]).astype(np.float32), c.first, model["crf"]["move"])


def _detector(blob: bytes | None):
    def detect(batches):
        model = _loaded(blob) if blob else None
        for batch in batches:
            for lo, hi in cp.slices(batch.column(3), 1_000_000):
                part = batch.slice(lo, hi - lo)
                d = np.where(part.column(4).to_numpy(zero_copy_only=False), EMPTY, -1)
                live = np.flatnonzero(d < 0)
                if model and len(live):
                    some = part.take(pa.array(live))
                    c, tags = tag(model, some.column(3), some.column(2))
                    d[live] = c.defects(tags)
                hit = pa.array(np.flatnonzero(d >= 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(hit), part.column(1).take(hit), pa.array(np.array(DEFECTS, object)[d[d >= 0]], pa.string())], ["tab", "row_key", "defect"])

    return detect


_BLANK = r"[\s\x{85}\x{a0}\x{ad}\x{1680}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]*"


def is_empty(text: Column) -> Column:
    """Null, blank or a bare placeholder; the pattern is anchored, so that a text is not read beyond its first words."""
    bare = "|".join(re.sub(r"([^\w])", r"\\\1", p) for p in PLACEHOLDERS)
    return text.isNull() | text.rlike(rf"(?i)\A{_BLANK}(?:{bare})?{_BLANK}\z")


def pair_defects(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Defective rows of pairs (tab, row_key, prompt, response): (tab, row_key, defect).

    One scan takes the sample, another tags all rows; a pair that is empty is no more than marked.
    """
    empty = is_empty(F.col("response"))
    picked = bounded_sample(pairs, MAX_MINED, ["tab", "row_key"], ["prompt", "response"], ~empty & F.col("prompt").rlike(r"\S"), ["prompt", "response"])
    texts, labels = labelled(samples)
    blob = _trained(tuple((r[0], r[1]) for r in picked), tuple(zip(texts, labels))) if picked and texts else None
    rows = pairs.select("tab", "row_key", "prompt", F.when(~empty, F.col("response")).alias("response"), empty.alias("empty"))
    return rows.mapInArrow(_detector(blob), "tab string, row_key bigint, defect string")
