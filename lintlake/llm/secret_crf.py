"""The linear-chain conditional random field that labels credential tokens.

Labels: 0 other, 1 a name or scheme word that announces a credential, 2 a credential. It is trained here, on examples
from a seeded generator whose size is a parameter: statements, settings, headers, URLs, comments and machine-made code
that hold credentials of public formats, and others that hold what is easily taken for one.
"""

from __future__ import annotations

import base64
import random
import string
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from lintlake.llm.secret_tokens import BITS, features, tokens, windows

LABELS = 3
#: Generated examples and passes of the training.
EXAMPLES = 9000
PASSES = 70
#: Added to the score of a credential: a missed one costs more than a masked label.
LEAN = 2.0

# Words that the generator builds names, passwords and neutral code from.
_NOUNS = "river stone bridge garden copper silver window forest harbor meadow planet rocket puzzle magnet cactus falcon lantern pepper saddle timber velvet walnut anchor badger cinder".split()
_VERBS = "load send parse merge track build fetch render update format queue bind check sort index".split()
_NAMES = {
    "password": "password passwd pwd dbPassword db_password DB_PASS smtpPassword adminPass root_pw passphrase userPassword mysqlPassword redisPassword loginPwd ftp_password keystorePass".split(),
    "hex": "apiKey api_key API_KEY xApiKey X-Api-Key mapsApiKey serviceApiKey apikey weatherApiKey geoKey".split(),
    "token": "authToken accessToken access_token refreshToken bearerToken token sessionToken apiToken idToken ACCESS_TOKEN service_token".split(),
    "secret": "clientSecret client_secret appSecret oauthSecret CLIENT_SECRET webhookSecret sharedSecret secret consumerSecret".split(),
    "sign": "signingSecret signing_key awsSecretAccessKey AWS_SECRET_ACCESS_KEY secretKey secretAccessKey hmacSecret signatureKey s3SecretKey encryptionKey".split(),
    "licence": "licenseKey license_key serviceKey LICENSE_KEY activationKey productKey licenceKey serialKey".split(),
    "aws_access_key": "awsKey accessKeyId AWS_ACCESS_KEY_ID s3AccessKey cloudAccess".split(),
    "github_token": "githubToken repoToken GH_TOKEN ciToken release deployer".split(),
    "gitlab_token": "gitlabToken deployToken mirror CI_JOB".split(),
    "npm_token": "npmToken publishToken registryAuth NPM_TOKEN".split(),
    "slack_token": "slackToken botToken chatToken notifier".split(),
    "sendgrid_key": "sendgridKey mailKey mailerKey outbound".split(),
    "stripe_live_key": "stripeKey payKey billingKey checkout".split(),
    "google_api_key": "googleKey firebaseKey mapKey".split(),
    "jwt_token": "jwt jwtToken sessionJwt idToken serviceJwt".split(),
}
_SAFE_NAMES = {
    "commit": "commit revision gitSha git_sha head ref sha".split(),
    "hash": "sha256 sha256Hash checksum digest md5 contentHash fingerprint".split(),
    "etag": "etag ETag cacheTag".split(),
    "uuid": "requestId request_id traceId buildId correlationId sessionId deviceId nodeId".split(),
    "integrity": ["integrity"],
    "label": "passwordLabel passwordHint pwdHelp tokenTitle secretHelp keyLabel passwordError".split(),
    "path": "tokenPath secretName keyRef passwordField secretPath credentialFile keyFile".split(),
    "scheme": "tokenType authScheme headerName tokenName csrfHeader".split(),
    "plain": "title label region owner status kind stage".split(),
}


class Maker:
    """Seeded examples: text and the spans of its credentials and announcing names."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def text(self, alphabet: str, lo: int, hi: int | None = None) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(lo, hi or lo)))

    def noun(self) -> str:
        return self.r.choice(_NOUNS)

    def password(self, url: bool = False) -> str:
        r = self.r
        marks = "_-.x" if url else "!#%*_-.@"
        a, b = self.noun(), self.noun()
        return r.choice([
            lambda: f"{a.title()}{r.choice(marks)}{b}{r.randint(10, 9999)}", lambda: f"{a}{r.randint(1970, 2026)}{r.choice(marks)}",
            lambda: f"{a}{r.choice('-._')}{self.text('0123456789abcdef', 6)}",
            lambda: self.text(string.ascii_letters + string.digits + ("-_" if url else "!#%*_-"), 9, 18),
            lambda: self.text(string.ascii_letters + string.digits + ("-_" if url else "!#%*_-"), 9, 18),
            lambda: self.text(string.ascii_letters + ("-_" if url else "!#%*_-"), 10, 18),
            lambda: self.text(string.ascii_letters + string.digits, 9, 18), lambda: self.text(string.ascii_letters + string.ascii_letters + "_-", 8, 13),
        ])()

    def value(self, kind: str) -> str:
        r, alnum = self.r, string.ascii_letters + string.digits
        url = alnum + "-_"
        return {
            "password": self.password, "hex": lambda: self.text("0123456789abcdef", r.choice([32, 40])), "token": lambda: self.text(url, 32, 62),
            "secret": lambda: self.text(alnum, 26, 44), "sign": lambda: self.text(alnum + "+/", 40), "licence": lambda: "-".join(self.text(string.ascii_uppercase + string.digits, 5) for _ in range(r.choice([4, 5]))),
            "aws_access_key": lambda: "AKIA" + self.text(string.ascii_uppercase + "234567", 16), "github_token": lambda: f"gh{r.choice('posru')}_" + self.text(alnum, 36),
            "gitlab_token": lambda: "glpat-" + self.text(url, 20), "npm_token": lambda: "npm_" + self.text(alnum, 36),
            "slack_token": lambda: f"xox{r.choice('abp')}-{self.text(string.digits, 11)}-{self.text(string.digits, 11)}-{self.text(alnum, 24)}",
            "sendgrid_key": lambda: f"SG.{self.text(url, 22)}.{self.text(url, 43)}", "stripe_live_key": lambda: "sk_live_" + self.text(alnum, 24),
            "google_api_key": lambda: "AIza" + self.text(url, 35), "jwt_token": self.jwt,
        }[kind]()

    def jwt(self) -> str:
        r = self.r
        enc = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
        head = '{"alg":"%s","typ":"JWT"}' % r.choice(["HS256", "RS256", "none", "None"])
        return f"{enc(head)}.{enc('{"sub":"%d","scope":"%s","iat":%d}' % (r.randint(1, 99999), self.noun(), r.randint(1600000000, 1800000000)))}.{self.text(string.ascii_letters + string.digits + '-_', 43)}"

    def pem(self, what: str, end: str) -> str:
        body = end.join(self.text(string.ascii_letters + string.digits + "+/", 64) for _ in range(self.r.randint(3, 6)))
        return f"-----BEGIN {what}-----{end}{body}{end}-----END {what}-----"

    def neutral(self) -> str:
        v, n = self.r.choice(_VERBS), self.noun()
        return self.r.choice([v + n.title(), f"{v}_{n}", n, n.upper() + "_" + self.r.choice(["COUNT", "TITLE"]), v + n.title() + str(self.r.randint(2, 9))])

    def remark(self) -> str:
        """A comment as people write it, or a template that builds a path."""
        r = self.r
        return r.choice(["// ", "# ", " * ", "  // "]) + r.choice([
            f"see ticket {self.text(string.ascii_uppercase, 2, 4)}-{r.randint(1, 9999)} about the {self.noun()}", f"TODO: drop this once the {self.noun()} moves", f"{self.noun()} v{r.randint(1, 9)}.{r.randint(0, 40)}.{r.randint(0, 9)} (MIT)",
            f"why: the {self.noun()} is shared with http://{self.noun()}.example.com/{self.noun()}", f"generated {r.randint(2015, 2026)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:{r.randint(10, 59)}:00Z by {self.noun()}-gen", f"built from {self.text('0123456789abcdef', 40)}", f"source: {self.noun()}/{self.noun()}.{r.choice(['js', 'py', 'proto'])}", f"request {'-'.join(self.text('0123456789abcdef', k) for k in (8, 4, 4, 4, 12))} took {r.randint(1, 999)}ms",
        ]) + "\n" if r.random() < 0.75 else f"const {self.neutral()} = `/{r.choice(['api/v1', 'api/v2', 'svc', 'internal', 'rest'])}/{self.noun()}s/{r.choice(['', str(r.randint(1, 99999)), self.noun()])}/${{{self.neutral()}}}`;\n"

    def safe(self) -> tuple[str, str]:
        """A name and a value that is no credential."""
        r = self.r
        hexes = "0123456789abcdef"
        kind = r.choice(["commit", "hash", "etag", "uuid", "uuid", "integrity", "label", "path", "scheme", "plain", "holder", "holder", "holder", "env", "piped", "piped", "piped", "url", "blob", "data", "path2", "code"])
        if kind == "holder" or kind == "env":
            name = r.choice(_NAMES[r.choice(["password", "hex", "token", "secret", "sign"])])
            value = r.choice([
                "changeme", "example-key-0000", "dummy-token-for-docs", "<your-token>", "insert-secret-here", "x" * r.randint(8, 32), "x" * 24, "your-api-key", "YOUR_API_KEY", "sample-secret",
                "placeholder", "REPLACE_ME", "test-key-example", "********", "todo", "not-a-real-key", "xxxx-xxxx-xxxx", "<password>", "example_password",
            ] if kind == "holder" else [f"${{{self.noun().upper()}_KEY}}", "{{ vault.api_key }}", "${DB_PASSWORD}", f"vault/{self.noun()}/{self.noun()}", f"%({self.noun()})s", "$SECRET", "process.env.SECRET_KEY", "env:API_TOKEN"])
            return name, value
        value = {
            "commit": lambda: self.text(hexes, 40), "hash": lambda: self.text(hexes, r.choice([32, 64, 64])), "etag": lambda: self.text(hexes, r.choice([16, 20, 32])),
            "uuid": lambda: "-".join(self.text(hexes, k) for k in (8, 4, 4, 4, 12)), "integrity": lambda: f"sha{r.choice([256, 384, 512])}-" + self.text(string.ascii_letters + string.digits + "+/", 64),
            "label": lambda: f"Passwords need {r.randint(6, 20)} characters and a {self.noun()}", "path": lambda: f"{r.choice(['secrets', 'vault', 'input', 'config', 'forms'])}/{self.noun()}/{self.noun()}",
            "scheme": lambda: r.choice(["Bearer", "Basic", "X-CSRF-Token", "X-Auth-Token", "session_token"]), "plain": lambda: r.choice([self.noun(), f"{self.noun()} {self.noun()}", f"{self.noun()}-{r.randint(1, 3)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"]),
            "piped": lambda: self.text(string.ascii_letters + string.digits, 12, 40) + f"|{r.randint(1, 999999)}", "url": lambda: f"https://{self.noun()}.example.com/api/v{r.randint(1, 4)}/{self.noun()}/{r.randint(1, 99999)}?page={r.randint(1, 30)}&t={self.text(hexes, 4)}",
            "blob": lambda: self.text(string.ascii_letters + string.digits + "+/", 72, 120), "data": lambda: "data:image/png;base64," + self.text(string.ascii_letters + string.digits + "+/", 40, 90),
            "path2": lambda: f"/api/v{r.randint(1, 4)}/{self.noun()}s/{r.randint(1, 99999)}/{self.noun()}", "code": lambda: f"{self.noun().title()}Service/Op{r.randint(1, 99):03d}",
        }[kind]()
        if kind == "piped" and r.random() < 0.8:
            return self.text(string.ascii_lowercase, 3, 12), value
        return (r.choice(_SAFE_NAMES[kind]) if kind in _SAFE_NAMES else self.neutral()), value

    def example(self) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
        r = self.r
        q = r.choice("\"'")
        pre = r.choice(["", "", f"const {self.neutral()} = {r.randint(1, 9999)};\n", f"return {self.neutral()}\n", f"{self.neutral()}: /api/v{r.randint(1, 4)}/{self.noun()}\n", f"{self.neutral()}({q}{self.noun()}{q});", f"{self.noun().upper()}={r.randint(1, 9999)}\n", f"var {r.choice('abc')}={{x:{r.randint(1, 999)},t:\"{self.noun()}\"}};", self.remark(), self.remark()])
        post = r.choice(["", "\n", ";\n", f"\nconst {self.neutral()} = {q}{self.noun()}{q}\n", f", {self.neutral()}: {r.randint(1, 99)} }}\n", f";if({r.choice('xyz')}>{r.randint(1, 60)})try{{a(b)}}catch(e){{c=void 0}}", f"\n{self.neutral()}: {self.noun()}\n", "\n" + self.remark()])
        roll = r.random()
        secret, names, scheme = True, [], ""
        if roll < 0.40:
            name, value = self.safe()
            secret = False
            if len(value) >= 70 and value.isascii() and " " not in value and "://" not in value and "," not in value and r.random() < 0.7:  # a line of a longer literal
                lines = [f'    "{self.text(string.ascii_letters + string.digits + "+/", 72)}"' for _ in range(r.randint(2, 4))]
                sep = r.choice(["\n", ",\n"])
                return f"{r.choice(['PAYLOAD', 'data', 'BLOB'])} = (\n" + sep.join(lines) + "\n)\n", [], []
            if "|" in value and r.random() < 0.7:  # an entry of a table
                pre = "".join(f'  "{self.text(string.ascii_lowercase, 3, 12)}": "{self.text(string.ascii_letters + string.digits, 12, 40)}|{r.randint(1, 999999)}",\n' for _ in range(r.randint(1, 3)))
            if r.random() < 0.08:
                name, value = r.choice([("publicKey", "PUBLIC KEY"), ("certificate", "CERTIFICATE"), ("caCert", "CERTIFICATE"), ("publicKey", "RSA PUBLIC KEY"), ("publicKey", "CERTIFICATE")])
                value = self.pem(value, r.choice(["\n", "\\n", "\n    "]))
        elif roll < 0.47:
            name, value = r.choice(["privateKey", "private_key", "PRIVATE_KEY", "signing_pem", "tlsKey", self.neutral()]), self.pem(r.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]), r.choice(["\n", "\\n", "\n    "]))
        elif roll < 0.57:
            name, scheme = r.choice(["Authorization", "authHeader", "headers", "auth", "proxyAuthorization", "legacyAuth", "basicAuth", self.neutral()]), r.choice(["Bearer ", "Bearer ", "Basic ", "Token "])
            value = base64.b64encode(f"{self.noun()}-svc:{self.password()}".encode()).decode() if scheme == "Basic " else r.choice([self.jwt, lambda: self.value("token")])()
        elif roll < 0.66:
            name = r.choice(["dbUrl", "DATABASE_URL", "mongo", "queueUrl", "cacheUri", "redisUrl", "dsn", self.neutral()])
            secret = r.random() < 0.75
            value = self.password(url=True) if secret else r.choice(["${DB_PASSWORD}", "${PASS}", "<password>", "changeme", "{{ vault.db }}", "%s"])
            head = f"{r.choice(['postgres', 'mysql', 'redis', 'mongodb', 'amqp', 'https'])}://{self.noun()}{r.choice(['_rw', '', '-svc'])}:"
            body, tail = value, f"@{self.noun()}.{self.noun()}.internal:{r.randint(1000, 9999)}/{self.noun()}"
            left = r.choice([f"const {name} = {q}", f"{name}={q}", f"  {name}: {q}", f"\"{name}\": {q}", f"// {name}: ", f"# {name} = ", f"const {name} = `", f"set({q}{name}{q}, {q}"])
            right = "" if left[:1] in "/#" else "`" if left[-1] == "`" else q
            text = pre + left + head
            span = (len(text), len(text) + len(body))
            return text + body + tail + right + post, [span] if secret else [], []
        else:
            kind = r.choice([k for k in _NAMES for _ in range(3 if k in ("password", "hex", "token", "secret", "sign") else 1)])
            name, value = r.choice(_NAMES[kind]), self.value(kind)
            if kind in ("password", "token", "secret") and r.random() < 0.1:
                name = r.choice(["login", "credential", "auth", "pass", "pin"]) + r.choice(["", "Value", "_default"])
        bare = " " not in value and "\n" not in value
        forms = ["const {n} = {q}{v}{q}", "{n} = {q}{v}{q}", "  {n}: {q}{v}{q}", '"{n}": "{v}"', "{N}={q}{v}{q}", "export {N}={q}{v}{q}", "set({q}{n}{q}, {q}{v}{q})", "req.setHeader({q}{n}{q}, {q}{v}{q})", 'var k={{{n}:"{v}"}}', "client = dict({n}={q}{v}{q}, retries=3)", 'window.__CFG__ = {{ "{n}": "{v}" }}', "  '{n}': '{v}',"]
        if bare:
            forms += ["{N}={v}", "// {n}: {v}", "# {n} = {v}", " * {n}: {v}", "  {n}: {v}", "export {N}={v}"]
            if not scheme:
                forms += ['fetch("https://h.example.internal/v1/ping?{n}={v}")'] * 2
        if value.startswith("-----") and "\n" in value:
            forms = ["const {n} = `{v}`", '{n} = """{v}"""', "  {n}: |\n    {v}", "{n} = '''{v}'''"]
        form = r.choice(forms)
        if secret and bare and r.random() < 0.13:  # a neutral name: only the value and its quotes tell
            form, name = "const {n} = `{v}`", self.neutral()
        elif not secret and r.random() < 0.05:
            form = "const {n} = `{v}`"
            name, value = self.neutral(), r.choice([f"/api/v{r.randint(1, 4)}/{self.noun()}/${{{self.neutral()}}}", f"{self.noun()} {self.noun()}", f"/api/v2/{self.noun()}s/{r.randint(1, 9999)}"])
        left, right = form.split("{v}")
        fill = lambda s: s.replace("{n}", name).replace("{N}", name.upper() if name.islower() else name).replace("{q}", q).replace("{{", "{").replace("}}", "}")
        left, right = fill(left), fill(right)
        text = pre + left + scheme
        span = (len(text), len(text) + len(value))
        if secret:
            at = (pre + left).rfind(name)
            if at >= 0:
                names.append((at, at + len(name)))
            if scheme:
                names.append((len(pre + left), len(pre + left) + len(scheme) - 1))
        return text + value + right + post, [span] if secret else [], names


class PlaceMaker(Maker):
    """Examples of credentials in paths and fragments of URLs and of long tokens, and of what else stands there."""

    def example(self) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
        r = self.r
        upper, alnum, hexa = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef"
        host = f"https://{r.choice(['api', 'hooks', 'cdn', self.noun()])}.{self.noun()}.{r.choice(['com', 'example', 'internal', 'org'])}/"
        secret, tail = r.random() < 0.5, ""
        if secret and r.random() < 0.25:
            head, value = "", ".".join(self.text(alnum + "-_", n, n + 90) for n in (30, r.randint(120, 500), r.randint(43, 342)))
            value = "eyJ" + value
            name = r.choice(["token", "accessToken", "idToken", "authorization", self.neutral()])
            left = r.choice([f"const {name} = '", f"{name}: \"Bearer ", f'"{name}": "', f"{name} = '"])
        else:
            left = r.choice([f"const {self.neutral()} = '", f"fetch('", f'"url": "', f"url: '", f"curl '", f"post(\"", f"// see "])
            formed = lambda: self.value(r.choice(["aws_access_key", "github_token", "stripe_live_key", "google_api_key", "npm_token", "gitlab_token"]))
            if secret:
                head, value, tail = r.choice([
                    lambda: (f"services/T{self.text(upper, 8, 10)}/B{self.text(upper, 8, 10)}/", self.text(alnum, 24), ""), lambda: (f"bot{r.randint(10**8, 10**10)}:", self.text(alnum + "-_", 35), r.choice(["", "/sendMessage", "/getUpdates"])),
                    lambda: (f"api/webhooks/{r.randint(10**17, 10**18)}/", self.text(alnum + "-_", 64, 68), ""), lambda: (f"{r.choice(['keys', 'token', 'v1', self.noun()])}/", formed(), r.choice(["", "/use", "?x=1"])),
                    lambda: (f"{self.noun()}/", formed(), ""),
                    lambda: (f"{r.choice(['', 'cb', 'login/done'])}#{r.choice(['access_token', 'id_token', 'token'])}=", r.choice([self.jwt, formed, lambda: self.value('token')])(), r.choice(["", "&state=x1", "&token_type=bearer"])),
                ])()
            else:
                value = r.choice([
                    lambda: f"{self.noun()}/{self.text(hexa, 8)}-{self.text(hexa, 4)}-{self.text(hexa, 4)}-{self.text(hexa, 4)}-{self.text(hexa, 12)}", lambda: f"{self.noun()}/commit/{self.text(hexa, 40)}", lambda: f"static/{self.noun()}.{self.text(hexa, 8, 20)}.{r.choice(['js', 'css', 'png'])}",
                    lambda: f"{self.noun()}-{self.noun()}/{r.randint(1, 10**6)}-{self.noun()}", lambda: f"v{r.randint(1, 4)}/{self.noun()}#{self.noun()}-{r.randint(1, 9)}-{self.noun()}", lambda: f"{self.noun()}/blob/main/{self.noun()}_{self.noun()}{r.randint(1, 99)}.ts#L{r.randint(1, 900)}-L{r.randint(1, 900)}",
                    lambda: f"{self.noun()}@{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}/dist/{self.noun()}.min.js", lambda: f"services/T{self.text(upper, 8, 10)}/B{self.text(upper, 8, 10)}", lambda: f"#/{self.noun()}/:{self.noun()}Id/{self.noun()}2024", lambda: f"keys/{{{self.noun()}Id}}/{self.noun()}#state=x1y2",
                    lambda: f"{self.noun()}/{self.text(hexa, 24, 32)}", lambda: f"{self.noun()}/{self.text(hexa, 64)}/raw", lambda: f"cb#token=${{{self.noun()}}}",
                ])()
                head = ""
            head = host + head
        text = left + head
        right = "'" if "'" in left else '"' if '"' in left else "\n"
        return text + value + tail + right + r.choice(["", ";\n", ")\n", ",\n"]), [(len(text), len(text) + len(value))] if secret else [], []


#: Of so many examples one is of a place or length that ``Maker`` has not; they come on top of the others.
PLACES = 9


def labelled(count: int, seed: int, maker: type[Maker] = Maker) -> list[tuple[list[list[int]], list[int]]]:
    """Windows of generated examples as feature slots and labels."""
    maker, out = maker(seed), []
    for _ in range(count):
        text, secrets, names = maker.example()
        ends, announce = {s[1]: s for s in secrets}, {n: 1 for n in names}
        for w in windows(tokens(text)):
            y = []
            for t in w:
                hit = ends.get(t.end) == (t.start, t.end)
                y.append(2 if hit else 1 if (t.start, t.end) in announce else 0)
            out.append(([features(w, k) for k in range(len(w))], y))
    return out


@dataclass
class Crf:
    emit: np.ndarray  # (slots, labels)
    move: np.ndarray  # (labels, labels)
    start: np.ndarray

    def label(self, windows: list[list[tuple[int, ...]]]) -> list[list[int]]:
        """The best labels of each window; a credential is preferred where the margin is below ``LEAN``.

        All windows are scored and walked at once, step by step, the longest first, so that those that still go on
        are always the first rows.
        """
        tokens = [f for w in windows for f in w]
        if not tokens:
            return [[] for _ in windows]
        width = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int64, int(width.sum()))
        e = np.add.reduceat(self.emit[flat], np.cumsum(width) - width)
        e[:, 2] += LEAN
        lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        at, steps = first[order], int(lengths.max())
        going = np.searchsorted(-lengths[order], -np.arange(1, steps + 1), "right")  # windows with more than t tokens
        best = self.start + e[at[: going[0]]]
        came = np.zeros((len(tokens), LABELS), np.int8)
        final = np.zeros(len(windows), np.int64)
        for t in range(1, steps):
            n = going[t]
            final[n : going[t - 1]] = best[n:].argmax(1)
            options = best[:n, :, None] + self.move
            here = at[:n] + t
            came[here] = options.argmax(1)
            best = options.max(1) + e[here]
        final[: going[steps - 1]] = best.argmax(1)
        labels = np.zeros(len(tokens), np.int64)
        now = np.zeros(len(windows), np.int64)
        for t in range(steps - 1, -1, -1):
            n = going[t]
            ends = going[t + 1] if t + 1 < steps else 0
            now[ends:n] = final[ends:n]
            here = at[:n] + t
            labels[here] = now[:n]
            now[:n] = came[here, now[:n]]
        out = labels.tolist()
        return [out[a : a + n] for a, n in zip(first.tolist(), lengths.tolist())]

    def viterbi(self, slots: list[list[int]]) -> list[int]:
        return self.label([slots])[0]


def train(data: list[tuple[list[list[int]], list[int]]], passes: int = PASSES, rate: float = 0.08, weight: float = 2e-5) -> Crf:
    """Maximum likelihood by full-batch gradients (forward-backward over all windows at once) with Adam steps."""
    length = max(len(y) for _, y in data)
    width = max(len(f) for x, _ in data for f in x)
    n, pad = len(data), 1 << BITS
    idx = np.full((n, length, width), pad, np.int32)
    gold = np.zeros((n, length), np.int64)
    mask = np.zeros((n, length), bool)
    for i, (x, y) in enumerate(data):
        for t, f in enumerate(x):
            idx[i, t, : len(f)] = f
        gold[i, : len(y)], mask[i, : len(y)] = y, True
    used = np.unique(idx)
    idx = np.searchsorted(used, idx).astype(np.int32)
    pad_at = int(np.searchsorted(used, pad))
    slots = len(used)
    onehot = np.eye(LABELS)[gold] * mask[..., None]
    params = [np.zeros((slots, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat, active = idx[mask], mask
    cols = flat.ravel()
    gold_move = np.zeros((LABELS, LABELS))
    both = mask[:, 1:]
    np.add.at(gold_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_start = np.bincount(gold[:, 0], minlength=LABELS)
    for step in range(1, passes + 1):
        emit, move, start = params
        e = np.zeros((n, length, LABELS))
        e[mask] = emit[flat].sum(1)
        a = np.zeros((n, length, LABELS))
        a[:, 0] = start + e[:, 0]
        for t in range(1, length):
            new = np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1) + e[:, t]
            a[:, t] = np.where(active[:, t, None], new, a[:, t - 1])
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        b = np.zeros((n, length, LABELS))
        g_move = np.zeros((LABELS, LABELS))
        for t in range(length - 2, -1, -1):
            nxt = (e[:, t + 1] + b[:, t + 1])[:, None, :] + move
            b[:, t] = np.where(active[:, t + 1, None], np.logaddexp.reduce(nxt, axis=2), 0)
            live = active[:, t + 1]
            g_move += np.exp(a[live, t, :, None] + nxt[live] - z[live, None, None]).sum(0)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        delta = (p - onehot)[mask]
        grad = np.stack([np.bincount(cols, np.repeat(delta[:, k], width), slots) for k in range(LABELS)], 1)
        grad[pad_at] = 0
        grads = [grad / n + weight * emit, (g_move - gold_move) / n, (p[:, 0].sum(0) - gold_start) / n]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    emit = np.zeros(((1 << BITS) + 1, LABELS), np.float32)
    emit[used] = params[0]
    emit[1 << BITS] = 0
    return Crf(emit[:-1], params[1].astype(np.float32), params[2].astype(np.float32))


@lru_cache(4)
def model(examples: int = EXAMPLES, seed: int = 7) -> Crf:
    """The trained labeller; the same for the same parameters."""
    return train(labelled(examples, seed) + labelled(examples // PLACES, seed, PlaceMaker))
