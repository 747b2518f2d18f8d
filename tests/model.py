"""A sequential model of the fold, one event at a time, for tests."""

STATES = {"entry.resolved": "RESOLVED_ONLINE", "entry.failed": "FAILED", "entry.expired": "EXPIRED"}


class Model:
    def __init__(self):
        self.entries, self.moves, self.tally, self.conflicts, self.records = {}, {}, {}, {}, []
        self.parked_undos, self.parked_steps = {}, {}

    def apply(self, seq, id, type, p):
        if type == "entry":
            self.entries[id] = {"state": "RECORDED", "voided": int(bool(self.parked_undos.get(id)))}
            for k, (step, by) in enumerate(self.parked_steps.pop(id, [])):
                self._step(id, step, by, early=True, first=k == 0)
        elif type in STATES:
            target = p["event_id"]
            if target in self.entries:
                self._step(target, type, id, early=False, first=self.entries[target]["state"] not in STATES.values())
            else:
                self.parked_steps.setdefault(target, []).append((type, id))
                self.conflicts[f"cf-{id}-unknown-entry"] = ("unknown-entry", "open")
        elif type in ("tally.add", "tally.remove"):
            q, have = p["qty"], self.tally.get(p["item"], 0)
            short = type == "tally.remove" and q > have
            if short:
                self.conflicts[f"cf-{id}-underflow"] = ("underflow", "open")
            else:
                self.tally[p["item"]] = have + (q if type == "tally.add" else -q)
            self.moves[id] = {"item": p["item"], "qty": q if type == "tally.add" else -q, "voided": int(short)}
            if self.parked_undos.get(id):
                self._undo_move(id)
        elif type == "undo.compensate":
            t = p["reverses"]
            if t in self.entries:
                self.entries[t]["voided"] = 1
            elif not (t in self.moves and self._undo_move(t)):
                self.records.append(id)
                if t not in self.moves:
                    self.parked_undos.setdefault(t, []).append(id)
        else:
            self.records.append(id)

    def _undo_move(self, id):
        m = self.moves[id]
        if m["voided"]:
            return False
        m["voided"] = 1
        self.tally[m["item"]] -= m["qty"]
        return True

    def _step(self, target, type, by, early, first):
        if first:
            self.entries[target]["state"] = STATES[type]
            if early:
                self.conflicts[f"cf-{by}-unknown-entry"] = ("unknown-entry", "resolved")
        else:
            self.conflicts[f"cf-{by}-unknown-entry" if early else f"cf-{target}-{by}-double-resolve"] = ("double-resolve", "open")
