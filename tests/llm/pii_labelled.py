"""Documents labelled by hand, none of them written by the grammar that the field learns from.

A mark is [[kind|text]]. What the four patterns find themselves is not counted: figures are of
the other marks only.
"""

import re

MARKED = """
Please ring me on +1 (312) 555-0147 before noon. If nobody answers at [[phone|555-0147]], leave a note with the porter.
Reception: +49 30 5550 1234. The old extension 1234 no longer works, and room 5550 is closed.
Her card 4539 1488 0343 6467 was refused twice; the bank wrote that [[card|4539148803436467,]] had expired in 2019.
Write to anna.schmidt@beispiel-verlag.de today. She reads [[email|ANNA.SCHMIDT@beispiel-verlag]] no longer, she says.
The server 192.168.10.44 went down at 03:15 and again at 04:40; see ticket 88213 and release 5.2.1 for the fix.
Fax and phone: +44 20 7946 0958 (day), [[phone|7946-0958]] (night). Office hours are 9:00 to 17:30, closed on 24.12.
Order 20231104 was paid by card 5500 0000 0000 0004 on 2023-11-04, amount $1,249.00, invoice 77120.
Our number is [[phone|(415) 555-0132]] and has been since 1998; before it was [[phone|(415) 555-0100]].
Call [[phone|212-555-0187]] or 1-page fax to [[phone|212-555-0188,]] we are open 7 days.
The book, ISBN 978-3-16-148410-0, costs 24.90 and has 312 pages; the second printing of 2004 has 318.
In 1815, 72000 men met 68000 near the village; by 20:30 some 15000 were lost, 3 in 10.
The router answers at 10.0.0.138 and not, as the manual of 2016 says, at [[ip|10.0.0.138:8080]] any more.
Transfer from 4111-1111-1111-1111 went through. Keep the last digits of 4111-1111-1111-1111 to yourself.
Mr Lee left the number +82 2 555 01 99 with the desk; dial [[phone|+82-2-555-0199]] from abroad.
Version 3.11.4 fixed 27 bugs, 3.11.5 another 9; 3.12 came on 2023-10-02 with 1200 changes.
She is @mlopez on the forum and her address is m.lopez@correo.example.es, never mlopez (at) correo.
Tel. [[phone|030/5550177]] oder +49 30 5550177, werktags 8 bis 16 Uhr, außer am 3. Oktober.
Le numéro +33 1 55 50 12 34 est celui du bureau; le 01 du mois, appelez après 14h30.
Lot 4400123 of 55010 units shipped on 12/05/2021, pallet 7 of 31, weight 1180.5 kg.
Contact bob@localhost from the console, or by mail bob.b@intranet.example.org from outside.
The hash 5d41402abc4b2a76b9719d911017c592 and the id 550e8400-e29b-41d4-a716-446655440000 are no secrets.
Caller [[phone|(650) 555-0161]] rang at 11:02, [[phone|(650) 555-0161]] again at 11:09 and +1 (650) 555-0161 at 11:30.
His Visa, 4012888888881881, was copied by hand as [[card|4012-8888-8888-1881.]] No other card is known.
From 2001 to 2012 the plant made 1234567 engines, 45 models, in 6 halls on 8.5 hectares.
Ping to 172.16.254.1 took 12.5 ms, to [[ip|(172.16.254.1)]] by the second line 80.25 ms, of 100 sent 98 came.
Emergency line: [[phone|555-0110]] (the full number is +1 (802) 555-0110). Room 110, floor 5.
Paid 1.299,00 on 01.02.2020 and 1.450,50 on 01.03.2020, customer 400231, tax 19%.
Latitude 52.520008, longitude 13.404954, altitude 34.2 m, measured on 2022-06-30 at 12:00:00.
Mail the list to [[email|editors@press]] or editors@press.example.net; issue 14, volume 3, pp. 201-219.
Die Karte 3782 822463 10005 gehört ihm nicht, und 378282246310005 steht auf dem Beleg 5521.
""".strip().split("\n")

_mark = re.compile(r"\[\[(\w+)\|(.*?)\]\]")


def labelled() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, marks as start, end, kind)."""
    out = []
    for line in MARKED:
        text, marks, at = "", [], 0
        for m in _mark.finditer(line):
            text += line[at : m.start()]
            marks.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], marks))
    return out


def measure(field, kinds) -> tuple[int, int, int]:
    """Added spans that meet a mark of their kind, added spans, and marks that no base span meets."""
    rows = labelled()
    right = said = there = 0
    for (text, marks), (base, added) in zip(rows, field.spans([t for t, _ in rows])):
        left = [m for m in marks if not any(s < m[1] and e > m[0] for s, _, e in base)]
        there += len(left)
        said += len(added)
        right += sum(any(s < b and e > a and kinds[k] == kind for a, b, kind in left) for s, k, e in added)
    return right, said, there
