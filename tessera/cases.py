"""Literal test sets: answers of known kinds, and questions that no document answers."""

from __future__ import annotations

from tessera.config import REFUSAL

#: (id, category, contexts, answer); category is grounded, hallucination or refusal.
ANSWER_CASES: list[tuple[str, str, list[str], str]] = [
    ("g1", "grounded", ["The harbour of Velm was dredged in 1911.", "Velm has two lighthouses."], "The harbour of Velm was dredged in 1911 [1]."),
    ("g2", "grounded", ["Each pump moves 40 litres per minute.", "The tank holds 600 litres."], "The tank holds 600 litres [2] and each pump moves 40 litres per minute [1]."),
    ("g3", "grounded", ["Permits expire after ninety days."], "Permits expire after ninety days [1]."),
    ("g4", "grounded", ["Dial | Range\nPressure | 0-16 bar"], "Pressure range 0-16 bar [1]."),
    ("g5", "grounded", ["Ferries leave Orsa at noon.", "Ferries return at dusk."], "Ferries leave Orsa at noon."),
    ("g6", "grounded", ["The archive keeps maps."], "The archive keeps maps [1] [4]."),
    ("h1", "hallucination", ["The harbour of Velm was dredged in 1911."], "The harbour of Velm was dredged in 1934 by Dutch engineers [1]."),
    ("h2", "hallucination", ["Each pump moves 40 litres per minute."], "Each pump moves 75 litres per minute [1]."),
    ("h3", "hallucination", ["Permits expire after ninety days.", "Fees double each spring."], "Fees double each spring [1]."),
    ("h4", "hallucination", ["Ferries leave Orsa at noon."], "Ferries leave Orsa at noon [3]."),
    ("r1", "refusal", ["The archive keeps maps."], REFUSAL),
    ("r2", "refusal", [], "The sources do not contain enough information about the bridge."),
    ("r3", "refusal", ["Velm has two lighthouses."], "Velm has a bridge [1]."),
]
UNANSWERABLE = [
    "Who painted the ceiling of the station at Velm?",
    "How many spare valves does the northern depot keep?",
    "What colour were the first ferry tickets?",
    "Which engineer signed the dredging contract?",
    "When does the winter timetable of the tramway begin?",
    "Why was the third lighthouse never built?",
]
