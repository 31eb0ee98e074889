"""A pairwise random field over labelled nodes, and loopy belief propagation on it.

Every node has a log-potential for each label it may have; an edge adds its strength where
both its nodes have the same label. Nodes and edges of many documents lie side by side in
one field, so that a round of messages is a few array operations whatever their number.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("", *KINDS)
AT = {label: i for i, label in enumerate(LABELS)}
#: Log-potential of a label that a node can't have.
NEVER = -1e9
#: Rounds and damping of message passing.
ROUNDS, DAMPING = 12, 0.3


class Field:
    """Nodes with scores per label ("" scores 0), edges with strengths in favour of equal labels."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.labels: list[int] = []
        self.scores: list[float] = []
        self.size = 0
        self.left: list[int] = []
        self.right: list[int] = []
        self.strength: list[float] = []

    def node(self, scores: dict[str, float]) -> int:
        for label, score in scores.items():
            self.nodes.append(self.size)
            self.labels.append(AT[label])
            self.scores.append(score)
        self.size += 1
        return self.size - 1

    def edge(self, a: int, b: int, strength: float) -> None:
        self.left.append(a)
        self.right.append(b)
        self.strength.append(strength)

    def own(self) -> np.ndarray:
        out = np.full((self.size, len(LABELS)), NEVER)
        out[:, 0] = 0.0
        out[self.nodes, self.labels] = self.scores
        return out

    def marginals(self, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
        """Probability of each label of each node by loopy sum-product; exact on trees, given rounds enough."""
        own = self.own()
        if not self.size:
            return own
        belief = own
        if self.left:
            a, b, k = np.array(self.left), np.array(self.right), np.array(self.strength)
            source, target, gain = np.concatenate([a, b]), np.concatenate([b, a]), np.expm1(np.concatenate([k, k]))[:, None]
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(source), len(LABELS)))

            def received() -> np.ndarray:
                return own + np.stack([np.bincount(target, weights=m, minlength=self.size) for m in messages.T], axis=1)

            for _ in range(rounds):
                without = received()[source] - messages[back]
                e = np.exp(without - without.max(axis=1, keepdims=True))
                new = np.log(e.sum(axis=1, keepdims=True) + gain * e)
                new -= new.max(axis=1, keepdims=True)
                messages = (1 - damping) * new + damping * messages
            belief = received()
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
