"""Whether a raw record conforms, character by character: the slow reading that the patterns of the loader are held against."""

BLANK = " \t\n\x0b\f\r"
STOPS = ",\n()[]"


class Fault(Exception):
    pass


class Reader:
    def __init__(self, text):
        self.text, self.at = text, 0

    def peek(self, ahead=0):
        return self.text[self.at + ahead] if self.at + ahead < len(self.text) else ""

    def blanks(self):
        while self.peek() and self.peek() in BLANK:
            self.at += 1

    def word(self, word):
        self.blanks()
        if not self.text.startswith(word, self.at):
            raise Fault(word)
        self.at += len(word)

    def maybe(self, what):
        """Read ``what`` or leave everything as it was."""
        before = self.at
        try:
            what()
            return True
        except Fault:
            self.at = before
            return False

    def exactly(self, text):
        if not self.text.startswith(text, self.at):
            raise Fault(text)
        self.at += len(text)

    def symbol(self):
        self.blanks()
        begin = self.at
        while self.peek() and self.peek() not in STOPS:
            self.at += 1
        return self.text[begin : self.at]

    def number(self):
        self.blanks()
        begin = self.at
        self.at += self.peek() == "-"
        digits = self.at
        while self.peek() and self.peek() in "0123456789":
            self.at += 1
        if self.at == digits:
            raise Fault("number")
        return int(self.text[begin : self.at])

    def quote(self, mark):
        self.word(mark)
        self.blanks()
        begin = self.at
        while char := self.peek():
            after = self.peek(1)
            if char == "\\":
                self.at += 2 if after == mark else 1
            elif char != mark:
                self.at += 1
            elif after == mark:
                self.at += 2
            elif after and after in ",[]()":
                break
            else:
                self.at += 1
        found = self.text[begin : self.at]
        self.word(mark)
        return found

    def symbol_or_quote(self):
        if not self.maybe(lambda: self.quote("'")):
            self.symbol()

    def listed(self, element):
        self.word("[")
        found = []

        def more():
            self.word(",")
            found.append(element())

        if self.maybe(lambda: found.append(element())):
            while self.maybe(more):
                pass
        self.word("]")
        return found

    def line_end(self):
        """At least one more character of the line."""
        begin = self.at
        while self.peek() and self.peek() != "\n":
            self.at += 1
        if self.at == begin:
            raise Fault("rest of the line")


def whole_number(text):
    body = text[1:] if text[:1] in ("+", "-") else text
    if not body or any(c not in "0123456789" for c in body) or not -(2**31) <= int(text) < 2**31:
        raise Fault("integer")
    return int(text)


def pair(text):
    left, slash, right = text.partition("/")
    if not slash:
        raise Fault("slash")
    return whole_number(left), whole_number(right)


def conforms(text):
    """Whether a record is one that loads."""
    if text is None or not text.strip(BLANK):
        return False
    try:
        read(Reader(text))
        return True
    except Fault:
        return False


def read(r):
    for name in ("args", "aas", "neg_list"):

        def optional(name=name):
            r.word(name)
            r.blanks()
            r.line_end()
            r.exactly("\n")

        r.maybe(optional)
    r.word("utterance(")
    parts = r.quote("'").split(".", 2)
    r.word(",")
    r.quote('"')
    r.word(",")
    place = r.symbol()
    r.word(",")
    r.listed(r.symbol)
    r.blanks()
    r.exactly(").\n")
    if len(parts) != 3:
        raise Fault("id")
    whole_number(parts[2])
    start, length = pair(place)
    while True:
        before = r.at
        if not r.maybe(lambda: r.word("phrase(")):
            break
        r.at = before
        phrase(r, start, length)
    r.word("'EOU'.")
    r.blanks()
    if r.peek():
        raise Fault("end")


def phrase(r, start, length):
    r.word("phrase(")
    r.symbol_or_quote()
    r.word(",")
    r.blanks()
    stop = r.at
    while stop < len(r.text) and r.text[stop] not in "\n\r\x85\u2028\u2029":
        stop += 1
    last = r.text.rfind("],", r.at, stop)
    if last < 0:
        raise Fault("],")
    r.at = last + 2
    place = r.symbol()
    r.word(",")
    r.line_end()
    r.exactly("\n")
    pair(place)
    r.word("candidates(")
    for _ in range(4):
        r.number()
        r.word(",")
    r.word("[")
    done = lambda: r.maybe(lambda: r.word("])."))
    if not done():
        candidate(r, start, length)
        while not done():
            r.word(",")
            candidate(r, start, length)
    r.blanks()
    r.exactly("mappings")
    r.line_end()


def candidate(r, start, length):
    r.word("ev(")
    score = r.number()
    r.word(",")
    r.quote("'")
    for _ in range(2):
        r.word(",")
        r.symbol_or_quote()
    r.word(",")
    r.listed(r.symbol)
    r.word(",")
    r.listed(r.symbol)
    r.word(",")
    inner = lambda: r.maybe(lambda: r.listed(r.number)) or r.number()
    r.listed(lambda: r.listed(inner))
    r.word(",")
    r.blanks()
    for after in (",", ""):
        r.exactly("yes" if r.text.startswith("yes", r.at) else "no")
        r.exactly(after)
    r.word(",")
    r.listed(lambda: r.quote("'"))
    r.word(",")
    places = r.listed(r.symbol)
    r.word(",")
    r.number()
    r.word(")")
    for place in places or [""]:
        left, slash, right = place.partition("/")
        if not slash or not left or not right or any(c not in "0123456789" for c in left + right) or max(int(left), int(right)) >= 2**31:
            raise Fault("position")
        if int(left) < start or int(left) + int(right) > start + length:
            raise Fault("outside")
    if not -(2**31) <= score < 2**31:
        raise Fault("score")
