"""Labelled lines to train on, made from templates; [[ and ]] enclose what is to be redacted.

Nothing here comes from real systems: values are drawn at random, names are common words.
"""

from __future__ import annotations

import base64
import random
import re
import string

_ALNUM = string.ascii_letters + string.digits
_WORDS = (
    "river stone winter marble copper silver window garden forest cloud rocket maple falcon summer thunder velvet biscuit"
    " sommer nebel regen kranich fleur brume cielo lobo estrella montagne canyon piano orchid ember granite tiger jazz lampe"
).split()
_PLAIN_WORDS = (
    "monkey dragon sunshine princess football shadow master hello freedom welcome charlie letme qwerty login secret iloveyou batman superman pepper ginger cookie"
    " summer winter autumn spring horse staple battery correct purple orange banana hunter ranger soccer hockey starwars computer internet pokemon chocolate"
).split()
_HOSTS = "db.shop.example mail.example.org cache.internal queue.example.net api.example.com node7.local 10.0.3.17 localhost".split()
_USERS = "admin root svc deploy app_rw reader ci alice bob_svc user1 build app postgres dev".split()
_SECRET_NAMES = (
    "api_key apiKey API_KEY api-key llm_api_key secret SECRET client_secret clientSecret access_token accessToken ACCESS_TOKEN"
    " auth_token authToken service_token gatewayToken token TOKEN signing_secret SIGNING_SECRET signingKey private_key repairKey"
    " llmKey refresh_token webhook_secret bot_token encryption_key masterKey sessionSecret secret_key AWS_SECRET_ACCESS_KEY"
).split()
_PASSWORD_NAMES = (
    "password PASSWORD passwd pwd pass db_password db.password dbPassword DB_PASS loginPw pw kennwort passwort contrasena"
    " motDePasse user_password keystorePassword adminPwd proxy.password PGPASSWORD mima"
).split()
_OTHER_NAMES = (
    "checksum CHECKSUM digest DIGEST sha256 SHA256 etag commit revision RUN_ID requestId trace_id build_id fingerprint icon ICON"
    " version model MODEL project PROJECT note NOTE title base_url BASE_URL path name label city branch image serialVersionUID cursor"
).split()
_NEUTRAL_NAMES = "extra option misc seed fixture73 value x data sample tmp arg setting FIELD header".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, letters: str, low: int, high: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(self.r.randint(low, high)))

    def hex(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def uuid(self) -> str:
        return "-".join(self.hex(n) for n in (8, 4, 4, 4, 12))

    def vendor(self) -> str:
        """A key with a telling beginning, of known or invented vendors."""
        r = self.r
        lead = r.choice(
            ["sk-", "sk-", "sk-proj-", "sk_live_", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "AKIA", "AIza", "pk_live_", "rk_test_", "key-", "npm_", "dop_v1_", "SG.", "hf_", "pypi-", "shpat_", "tok.",
             self.some(string.ascii_lowercase, 2, 4) + r.choice(["-", "_", "_live_", ".prod.", "_pat_", "-prod-", "_sk_", ".live.", "_test_", "_key_", "."])] * 2
        )
        if r.random() < 0.08:
            return f"{self.some(string.ascii_lowercase, 2, 4)}.{self.some(_ALNUM, 10, 14)}.{self.some(_ALNUM, 20, 28)}"
        if lead == "AKIA":
            return lead + self.some(string.ascii_uppercase + string.digits, 16, 16)
        letters = r.choice([_ALNUM, _ALNUM, _ALNUM, string.ascii_letters, string.ascii_lowercase + string.digits, "0123456789abcdef"])
        return lead + self.some(letters, 16, 40)

    def opaque(self) -> str:
        r = self.r
        return r.choice([
            lambda: self.some(_ALNUM, 28, 44), lambda: self.hex(r.choice([32, 40, 64])), self.uuid,
            lambda: base64.b64encode(bytes(r.randrange(256) for _ in range(r.choice([16, 24, 32])))).decode(),
            lambda: self.some(_ALNUM + "-_", 30, 44),
        ])()

    def jwt(self) -> str:
        part = lambda n: base64.urlsafe_b64encode(bytes(self.r.randrange(256) for _ in range(n))).decode().rstrip("=")
        head = base64.urlsafe_b64encode(self.r.choice([b'{"alg": "HS256", "typ": "JWT"}', b'{"typ":"JWT","alg":"RS256"}'])).decode().rstrip("=")
        body = base64.urlsafe_b64encode(f'{{"sub": "{self.hex(8)}", "exp": {self.r.randint(10**9, 2 * 10**9)}}}'.encode()).decode().rstrip("=")
        return f"{head}.{body}.{part(32)}"

    def password(self) -> str:
        r = self.r
        w = lambda: r.choice([str.lower, str.title])(r.choice(_WORDS))
        return r.choice([
            lambda: f"{r.choice(_WORDS)}-{r.choice(_WORDS)}-{r.randint(100, 9999)}",
            lambda: f"{w()}{r.choice('#_+%!-$&')}{w()}{r.randint(10, 9999)}", lambda: f"{w()}{r.choice('#_+%!-$&')}{w()}{r.randint(10, 99)}",
            lambda: f"{w()}{w()}{r.randint(100, 9999)}",
            lambda: f"{w()}{r.randint(100, 99999)}{r.choice('!?#_$')}",
            lambda: self.some(_ALNUM + "!#%&+_?", 9, 18) + str(r.randint(0, 9)),
            lambda: self.some(_ALNUM, 9, 14) + str(r.randint(0, 99)), lambda: self.some(string.ascii_letters, 7, 16),
            self.plain_password,
        ])()

    def plain_password(self) -> str:
        """What only its place tells to be a password: words, with few digits or none."""
        r = self.r
        w = lambda: r.choice(_PLAIN_WORDS) if r.random() < 0.6 else self.syllables()
        return r.choice([
            lambda: f"{w()}{r.randint(0, 9)}", lambda: f"{w()}{r.randint(10, 999)}", lambda: f"{w().title()}{r.randint(1, 99)}", lambda: f"{w()}{w()}", lambda: f"{w()}{w().title()}{r.randint(1, 99)}",
            w, lambda: f"{w().title()}{r.choice('!?.#')}", lambda: f"{w()}pw", lambda: f"{w()}{w()}{w()}", lambda: re.sub("[aeo]", lambda m: {"a": "4", "e": "3", "o": "0"}[m.group()], w() + w()),
        ])()

    def syllables(self) -> str:
        return "".join(self.r.choice("bdfgklmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(3, 5)))

    def secret(self) -> str:
        return self.r.choice([self.vendor, self.vendor, self.vendor, self.opaque, self.jwt])()

    def encoded(self) -> str:
        inner = self.r.choice([lambda: f"{self.r.choice(_USERS)}:{self.password()}", lambda: "key:" + self.vendor(), self.vendor])()
        return base64.b64encode(inner.encode()).decode()

    def placeholder(self) -> str:
        r = self.r
        return r.choice([
            "your api key", "<insert-key-here>", "<password>", "changeme", "CHANGE_ME", "xxxxxxxxxxxxxxxx", "sk-xxxxxxxxxxxxxxxxxxxxxxxx", "TODO",
            "sk-your-key-goes-here-0000000000", "your-token-here", "${LLM_API_KEY}", "${DB_PASSWORD}", "${TOKEN:-}", "$(cat /etc/app/token)", "$(pass show app/db)", "env:SERVICE_TOKEN",
            "vault:secret/data/app#token", "vault:secret/app", "op://team/item/field", "ssm:/prod/db/password", "{{ secrets.API_KEY }}", "%API_KEY%", "see password manager", "ask the admin", "from keychain", "none", "null", "", "example", "dummy",
            "********", "REPLACE_ME", "YOUR API KEY", "<insert key>", "env:API_KEY", "REDACTED", "<redacted>", "not-a-real-key", "placeholder", "secret", "password", "cache-key", "min 12 characters", "unset",
            "file:///etc/ssl/app.pem", "arn:aws:secretsmanager:eu-1:0000:secret:app", "insert token", "YOUR_API_KEY_HERE", "test", "aws-kms:alias/app",
            "****" + self.hex(4), "sk-****" + self.hex(4), "***" + self.hex(3), "$" + r.choice(_SECRET_NAMES).upper(), "@secret/" + r.choice(_WORDS),
            "Bearer ${TOKEN}", "Bearer <token>", "Bearer $TOKEN", "sha256:" + self.hex(64), "sk-...", "0000000000000000", "1234567890",
        ])

    def harmless(self) -> str:
        r = self.r
        return r.choice([
            lambda: self.hex(r.choice([32, 40, 64])), self.uuid, lambda: "sha256-" + self.hex(64), lambda: "sha256:" + self.hex(64),
            lambda: f"{r.choice(_WORDS)}-{r.randint(1, 999)}", lambda: f"https://{r.choice(_WORDS)}.{r.choice(_WORDS)}.invalid/v{r.randint(1, 3)}",
            lambda: str(r.randint(1, 10**6)), lambda: f"{r.choice(_WORDS)} {r.choice(_WORDS)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            lambda: "data:image/png;base64," + base64.b64encode(bytes(r.randrange(256) for _ in range(r.randint(20, 60)))).decode(),
            lambda: f"src/main/{r.choice(_WORDS)}/{r.choice(_WORDS).title()}{r.choice(_WORDS).title()}Test_Gen{r.randint(1, 9)}_V{r.randint(1, 40)}.java",
            lambda: f"{r.choice(_WORDS)}{r.choice(_WORDS).title()}{r.randint(0, 99)}", lambda: f"{r.choice(_WORDS)}-{r.choice(['large', 'mini', 'coder'])}-{r.randint(1, 9)}",
            lambda: f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:15:{r.randint(10, 59)}Z", lambda: "see <<<<<<< in the log", lambda: "100 % sure",
        ])()

    def pem_rest(self, kind: str) -> str:
        """What follows the first line of a key in a Java string."""
        r = self.r
        full = ["            + \"" + self.some(_ALNUM + "+/", 64, 64) + "\\n\"" for _ in range(r.randint(1, 5))]
        last = "            + \"" + self.some(_ALNUM + "+/", 20, 50) + r.choice(["==", "=", ""]) + "\\n\""
        return "\n".join([*full, last, f"            + \"-----END {kind}-----\";"])

    def name(self, names: list[str]) -> str:
        r, n = self.r, self.r.choice(names)
        k = r.random()
        return n.upper() if k < 0.1 else n.replace("_", ".") if k < 0.15 else f"{r.choice(_WORDS)}_{n}" if k < 0.2 else n

    def assigned(self, name: str, value: str) -> str:
        """A line of some language that gives ``name`` the marked ``value``."""
        r = self.r
        q = r.choice(['"', '"', "'"])
        line = r.choice([
            f"    private static final String {name} = \"{value}\";", f"    static final String {name} = \"{value}\";", f"    private final String {name} = \"{value}\";",
            f"    static String {name} = \"{value}\";", f"String {name} = \"{value}\";", f"        env.put(\"{name}\", \"{value}\");", f"        config.set(\"{name}\", \"{value}\")",
            f"{name} = {q}{value}{q}", f"{name}={q}{value}{q}", f"{name}={value}", f"{name} = {value}", f"export {name}={value}", f"  {name}: {q}{value}{q}", f"  {name}: {value}",
            f"  \"{name}\": \"{value}\",", f"  \"{name}\": \"{value}\"", f"  <property name=\"{name}\" value=\"{value}\"/>", f"  <{name}>{value}</{name}>",
            f"  <entry key=\"{name}\">{value}</entry>", f"builder.{name}(\"{value}\")", f"client = Client({name}={q}{value}{q}, timeout=3)",
            f"        System.setProperty(\"{name}\", \"{value}\");", f"--{name}={value}", f"  {name} = os.environ.get(\"X\", {q}{value}{q})", f"var {name} = \"{value}\";",
            f"    private static final String {name} =\n            \"{value}\";", f"{{\"{name}\": \"{value}\", \"user\": \"bob\"}}", f"const {name} = '{value}';",
        ])
        if r.random() < 0.02:
            line = re.sub(r"\"(.*?)\"", r"“\1”", line)
        k = r.random()
        if k < 0.06:
            line = f"    // {line.strip()}"
        elif k < 0.09:
            line = f"# {line.strip()}"
        elif k < 0.11:
            line = f"     * {line.strip()}"
        return line

    def positive(self) -> str:
        r = self.r
        k = r.random()
        mark = lambda v: f"[[{v}]]"
        host, user = r.choice(_HOSTS), r.choice(_USERS)
        if k < 0.26:
            return self.assigned(self.name(_SECRET_NAMES), mark(self.password() if r.random() < 0.15 else self.secret()))
        if k < 0.44:
            return self.assigned(self.name(_PASSWORD_NAMES), mark(self.plain_password() if r.random() < 0.25 else self.password()))
        if k < 0.52:
            return self.assigned(self.name(_NEUTRAL_NAMES), mark(self.vendor()))
        if k < 0.60:
            url = r.choice(["postgres://{u}:{p}@{h}/db", "jdbc:postgresql://{u}:{p}@{h}:5432/db", "https://{u}:{p}@{h}/x", "amqp://{u}:{p}@{h}", "redis://:{p}@{h}:6379/0",
                            "jdbc:mysql://{h}/x?user={u}&password={p}", "jdbc:h2:mem:x;USER={u};PASSWORD={p}"]).format(u=user, h=host, p=mark(self.plain_password() if r.random() < 0.25 else self.password()))
            if r.random() < 0.2:
                return url
            return self.assigned(r.choice(["url", "URL", "dsn", "DSN", "datasource", "DATASOURCE", "jdbcUrl", "connection", "broker"]), url)
        if k < 0.65:
            url = f"https://{host}/v1?{r.choice(['api_key', 'key', 'token', 'access_token', 'sig'])}={mark(self.secret())}"
            return r.choice([url, self.assigned(r.choice(["url", "endpoint", "webhook", "base_url"]), url), f"curl -s '{url}'"])
        if k < 0.75:
            v = r.choice([f"Bearer {mark(self.secret())}", f"Bearer {mark(self.secret())}", f"Basic {mark(self.encoded())}", f"token {mark(self.vendor())}"])
            return r.choice([
                f"        request.header(\"Authorization\", \"{v}\");", f"        request.setHeader(\"Authorization\", \"{v}\");", f"curl -H 'Authorization: {v}' https://{host}",
                self.assigned(r.choice(["authorization", "AUTHORIZATION", "Authorization", "header", "HEADER"]), v), v, f"# curl -H \"Authorization: {v}\" https://{host}/v1",
            ])
        if k < 0.80:
            n = self.r.choice(["AES_KEY", "HMAC_SECRET", "signingKey", "SECRET", "masterKey", "IV_KEY", "key"])
            if r.random() < 0.7:
                body = ", ".join(f"(byte) 0x{self.hex(2)}" for _ in range(r.choice([16, 24, 32])))
                return f"    private static final byte[] {n} = {{[[{body}]]}};"
            body = ", ".join(f"'{c}'" for c in self.password() if c not in "'\\[]")
            return f"    private static final char[] {r.choice(['PASSWORD', 'pwd', 'secret'])} = {{[[{body}]]}};"
        if k < 0.88:
            v, n = r.choice([self.vendor(), self.opaque()]), self.name(_SECRET_NAMES)
            i = r.randint(6, len(v) - 6)
            a, b = v[:i], v[i:]
            return r.choice([
                f"    private static final String {n} = \"[[{a}\"\n            + \"{b}]]\";", f"    private static final String {n} = \"[[{a}\" + \"{b}]]\";",
                f"{n} = '[[{a}' + '{b}]]'", f"    static final String {n} = String.join(\"\", \"[[{a}\", \"{b}]]\");", f"    String {n} = new StringBuilder(\"[[{a}\").append(\"{b}]]\").toString();",
                f"{n} = ('[[{a}'\n    '{b}]]')",
            ])
        if k < 0.92:
            kind = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
            body = base64.b64encode(bytes(r.randrange(256) for _ in range(48))).decode()
            if r.random() < 0.4:
                return f"    static final String PEM = \"[[-----BEGIN {kind}PRIVATE KEY-----\\n\"\n" + self.pem_rest(f"{kind}PRIVATE KEY")[:-2] + "]]\";"
            return r.choice([
                f"[[-----BEGIN {kind}PRIVATE KEY-----]]", f"    static final String PEM = \"[[-----BEGIN {kind}PRIVATE KEY-----\\n\" + \"{body}\\n\"]]",
                f"  key: \"[[-----BEGIN {kind}PRIVATE KEY-----\\n{body}]]\"", f"    \"[[-----BEGIN {kind}PRIVATE KEY-----\\n\"]]", f"PRIVATE_KEY=\"[[-----BEGIN {kind}PRIVATE KEY-----]]",
            ])
        if k < 0.95:
            note = r.choice(["use this account for local runs", "staging login is", "test account", "login", "ask for", "demo user", "Testkonto", "Anmeldung", "cuenta de prueba", "compte de test", "sign in as"])
            user = r.choice([user, f"{r.choice(_WORDS)}_{r.choice(['dev', 'test', 'ro'])}"])
            return f"{r.choice(['//', '//', '#', '     *'])} {note}{r.choice([':', ':', ''])} {user} / [[{self.password()}]]"
        if k < 0.963:
            if r.random() < 0.5:
                return f"    static final String {self.name(_SECRET_NAMES)} = decode(\"[[{self.encoded()}]]\");"
            return f"    String {self.name(_SECRET_NAMES)} = new String(Base64.getDecoder().decode(\"[[{self.encoded()}]]\"));"
        return r.choice([
            f"        login(\"{user}\", \"[[{self.password()}]]\");", f"mysql -u {user} -p[[{self.password()}]] {r.choice([f'-h {host}', 'app', '', 'shop < dump.sql'])}", f"curl -{r.choice(['u', 'su', 'X GET -u'])} {user}:[[{self.password()}]] https://{host}/{r.choice(['', 'v1', 'api'])}", f"sshpass -p [[{self.password()}]] ssh {user}@{host}", f"passphrase{r.choice([' = ', ': ', '='])}\"[[{' '.join(r.choice(_PLAIN_WORDS + _WORDS) for _ in range(r.randint(2, 4)))}]]\"", f"  auth: [{user}, \"[[{self.password()}]]\"]",
            f"DriverManager.getConnection(url, \"{user}\", \"[[{self.password()}]]\");", f"# old key: [[{self.vendor()}]]", f"// TODO remove [[{self.vendor()}]]",
            f"user={user};password=[[{self.password()}]]", f"     * Uses the token [[{self.vendor()}]] for now.",
        ])

    def setting(self) -> str:
        """The whole text of a setting that should hold a key; with the name put before it."""
        r = self.r
        mark = lambda v: f"[[{v}]]"
        if r.random() < 0.45:
            return r.choice([self.placeholder(), self.placeholder(), "sha256:" + self.hex(64)])
        return r.choice([
            lambda: mark(self.secret()), lambda: f"  {mark(self.secret())}", lambda: mark(self.password()), lambda: f"Bearer {mark(self.secret())}", lambda: mark(self.encoded()),
            lambda: f"https://x.invalid/v1?api_key={mark(self.secret())}", lambda: f'{{"key": "{mark(self.secret())}", "user": "alice"}}', lambda: mark(self.password()),
        ])()

    def plain(self) -> str:
        """A line of code or text in which nothing is given a value that could be a credential."""
        r = self.r
        w, v, x, y, n = r.choice(_WORDS), r.choice(_WORDS).title(), r.choice("abcijkmnpq"), r.choice("cdestuvwxy"), r.randint(0, 40)
        of, sign = r.choice(["Token", "Key", "Secret", "Password", "Name", "Size", "Parser"]), r.choice(["\\n", "\\t", "\\\\", "\\'", ";", "#", "/", "-", "[", ")", "x", "0"])
        return r.choice([
            f"char {w} = '{sign}', {y} = '{r.choice('!?.,:@|+*')}';", f"    if (c == '{sign}' || c == '\\'') {{", f"        case '{sign}': return '{r.choice('abXY_~^')}';", f"    static final char SEPARATOR = '{sign}';",
            f"while ({x} < {y} && {w}) {{ {v.lower()}(); }}", f"        for (int {x} = 0; {x} < {n} && !{w}; {x}++) {{", f"if ({x} > {n} || {y} <= {x} && {w}.ready()) return;", f"    return {x} != null && {x}.{w}{of}() == {y};",
            f"        boolean {w}{n} = {w}.is{of}() ? false : {x} > {n};", f"    String {w} = {v.lower()}.next{of}() ? {x} + \"{y}\" : \"{w}\";", f"        Object {x} = {w}.get{of}() ? {n}.5f + \"{y}\" : \"{x};", f"        double {w}{n} = {w}.peek{of}() * {n}.25 - {x};", f"        String {w} = {x} > {n} ? {r.randint(100, 9999)}L + \"{y}\" : \"{v}\";", f"        char {x} = {w}.read{of}() ? '{y}' : '?'; long {y} = {r.randint(100, 9999)}L + {n};", f"        Object {y} = ({w}.has{of}()) ? {r.randint(100, 9999)}L + \"a\" : \"{x}\";", f"        long {x} = {w}.{of.lower()}({n}) ? {r.randint(1, 9999)}L + {w}.size() : 0;",
            f"    public void {w}{v}{r.choice(['Stops', 'AtEnd', 'Again', 'WithNull'])}{r.randint(0, 30)}({r.choice(['', 'long id', 'String s'])}) {{", f"    void {w}{v}{r.randint(0, 99)}() throws IOException {{", f"private {v} {w}{v}{n}(int[] {x}) {{",
            f"        {w}.{v.lower()}{of}({x}, new {v}({n}), List.of(), Set.of({n}));", f"        assertTrue({w}.has{of}(new {v}({n}), Optional.empty()));", f"    {w}{v}{n}();", f"        return new {v}{of}({x}, {n});", f"    }} catch ({v}Exception {x}) {{",
            f"  <note>a &gt;&gt;&gt; b &amp;&amp; {w} &lt; {n}</note>", f"  <item label=\"{w} &amp;&amp;&amp; {v}\"/>", f"  <{w} text=\"&gt;&gt;&gt;&gt;&gt; {v}\"/>", f"  <{w}>{v} {n}</{w}>", f"  - {w}: {v}", f"# {v} and {w} are read in {n} steps", f"// the {w} {of.lower()} is checked by the {v} rule",
            f"     * @param {w}{of} the {of.lower()} of the {v}", f"    @{v}({w} = {n})", f"public interface {v}{of} extends Comparable<{v}> {{", f"def {w}_{v.lower()}{n}(self, {x}, {y}):", f"    return {x}[{n}] + {y}['{w}']", f"    for {x}, {y} in {w}.items():", f"}} else if ({w} instanceof {v}{of}) {{", "});", "}", "*/",
            f"\"{w}\": [{n}, null, true],", f"        verify({w}, never()).{v.lower()}{of}(any());", f"        when({w}.find{of}(anyInt())).thenReturn(\"{v.lower()}\");", f"        logger.info(\"no {of.lower()} for {{}} in {{}}\", {w}, {x});", f"Pattern {x} = Pattern.compile(\"[^{w[:3]}]+\\\\s*{y}?\");",
            f"    throw new IllegalStateException(\"{of.lower()} of {w} is missing\");", f"        {w}.set{of}(null);", f"        String {of.lower()} = {w}.{of.lower()}();", f"import {w}.{v.lower()}.{v}{of};",
            f"{'#' * r.randint(1, 5)} {v}", f"{'#' * r.randint(1, 5)} {v} {of.lower()}s", f"{n}. {v} {w}s", f"**{v}**: {w} {v.lower()}", f"{v} {w} {v.lower()}.", f"{v}", f"        {v}{of} {w} = new {v}{of}({x});", f"    private {v}Of{of} {w};", f"// since commit {self.hex(40)}", f"     * Taken over from {self.hex(40)}.",
        ])

    def negative(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.30:
            return self.assigned(self.name(_SECRET_NAMES + _PASSWORD_NAMES), self.placeholder())
        if k < 0.52:
            return self.assigned(self.name(_OTHER_NAMES), self.harmless())
        if k < 0.58:
            return self.assigned(self.name(_NEUTRAL_NAMES), r.choice([self.harmless(), self.placeholder()]))
        if k < 0.63:
            kind = r.choice(["PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY"])
            if r.random() < 0.5:
                sep = r.choice([" + ", "\n            + "])
                return f"    static final String {r.choice(['VERIFY', 'CERT', 'TRUSTED', 'publicKey'])} = \"-----BEGIN {kind}-----\\n\"\n" + self.pem_rest(kind).replace("\n            + ", sep)
            body = base64.b64encode(bytes(r.randrange(256) for _ in range(48))).decode()
            return r.choice([
                f"-----BEGIN {kind}-----", f"    static final String VERIFY = \"-----BEGIN {kind}-----\\n\" + \"{body}\\n\" + \"{body}\\n\"", "-----END PRIVATE KEY-----",
                f"    + \"{body}\\n\" + \"-----END PRIVATE KEY-----\\n\";", f"            + \"{body}\\n\"", body, f"{body}", f"ssh-rsa {body} user@host",
            ])
        if k < 0.69:
            host = r.choice(_HOSTS)
            return self.assigned(r.choice(["url", "URL", "dsn", "base_url", "BASE_URL"]), r.choice([
                f"jdbc:h2:mem:{r.choice(_WORDS)};USER=sa;PASSWORD=", f"postgres://{host}/db", f"https://{host}/v1?page=2", f"postgres://user:${{DB_PASS}}@{host}/x",
                f"https://user:<password>@{host}", f"https://{host}/v1?api_key=${{KEY}}", f"mailto:{r.choice(_WORDS)}@{host}", f"postgres://user:****@{host}/x", "user:password@host",
            ]))
        if k < 0.80:
            n = r.choice(_SECRET_NAMES + _PASSWORD_NAMES)
            w = r.choice(_WORDS)
            return r.choice([
                f"    private final String {n} = System.getenv(\"{n.upper()}\");", f"    static final String TOKEN_HEADER = \"X-Auth-Token\";", f"    static final String PASSWORD_FIELD = \"password\";",
                f"    // never paste a real token here, see the vault entry {w}/{w}", f"    private static final int MAX_TOKENS = {r.randint(100, 9000)};", f"  max_tokens: {r.randint(100, 9000)}",
                f"    private long tokenCount = {r.randint(100, 10**6)}L;", f"token_budget={r.randint(1, 9999)}", f"{n} = os.environ['{n.upper()}']", f"  {n}: !Ref {w.title()}Secret",
                f"        request.header(\"Authorization\", \"Bearer \" + {n});", f"        assertEquals(\"{w}-{r.randint(1, 999)}\", subject.{w}Token());", f"password_policy=min 12 characters",
                f"String {n} = vault.read(\"kv/{w}/{w}\");", f"    public void set{n.title()}(String {n}) {{ this.{n} = {n}; }}", f"if (!{n}.equals(other.{n})) return false;",
                f"        String {n} = readSecret(\"{w}-{r.randint(10, 99)}\");", f"api.key.file=/etc/keys/{w}.pem", f"  secretName: {w}-credentials-{r.randint(1, 9)}", f"    fail(\"bad token: {w}{r.randint(100, 999)}\");",
            ])
        if k < 0.83:
            w = r.choice(_PLAIN_WORDS)
            return r.choice([
                self.assigned(self.name(_OTHER_NAMES + _NEUTRAL_NAMES), self.plain_password()), f"        assertEquals(\"{w}\", subject.{w}Name());", f"user = \"{w}{r.randint(1, 99)}\"", f"  user: {w}", f"  username: {self.plain_password()}", f"login({w}, {w}Field)", f"passwordField.setText({w});", f"<label for=\"password\">{w}</label>", f"passwordLabel = \"{w.title()}:\"", f"password.length() > {r.randint(6, 20)}", f"tokens = {w}.split(\" \")",
            ])
        if k < 0.90:
            return self.plain()
        w, v = r.choice(_WORDS), r.choice(_WORDS).title()
        return r.choice([
            f"        assertEquals(\"{w}-{r.randint(1, 999)}\", item{r.randint(1, 99)});", f"     * Checks {w}{v}{r.randint(0, 9)} {{@link Keyed{v}Sorter}} with a {w}; see ticket {r.randint(100, 9999)}.",
            f"    @DisplayName(\"{w}{v}{r.randint(0, 9)}: ok\")", f"        subject = new {v}{r.choice(_WORDS).title()}Planner({r.randint(1, 9999)}L);", f"        var found{r.randint(1, 99)} = subject.{w}(\"{w}-{r.randint(1, 999)}\", {r.randint(1, 99)}.{r.randint(10, 99)}d);",
            f"class {v}{r.choice(_WORDS).title()}Test_Mutation_Gen{r.randint(1, 9)}_V{r.randint(1, 60)} {{", f"public class {v}{r.choice(_WORDS).title()}{r.choice(_WORDS).title()}Test_Crossover_Gen{r.randint(1, 9)}_{r.randint(1, 60)}x{r.randint(1, 60)} extends BaseSuite<{v}> implements AutoCloseable {{", f"public class {v}{r.choice(_WORDS).title()}TestV{r.randint(1, 60)} extends BaseSuite<{v}> {{", f"package org.{w}.{r.choice(_WORDS)};", f"      \"class\": \"{v}{r.choice(_WORDS).title()}V{r.randint(1, 20)}\",",
            f"DIGEST = 'sha256-{self.hex(64)}'", f"    static final String RUN_ID = \"{self.uuid()}\";", f"    static final String SHA256 = \"{self.hex(64)}\";", f"        assertEquals(\"{{\\\"{w}{v}\\\": [{r.randint(1, 99)}, {{}}]}}\", subject.dump());",
            f"    static final String ICON = \"data:image/png;base64,{base64.b64encode(bytes(r.randrange(256) for _ in range(60))).decode()}\";", f"  \"gen\": {r.randint(1, 20)},", f"    private static final long serialVersionUID = {r.randint(10**16, 10**18)}L;",
            f"        print(f'{{p}} {v}{r.randint(1, 99)}')", f"import org.{w}.{v};", f"<<<<<<< HEAD", f"        int value{r.randint(10, 99)} = subject.{w}{v}() >> {r.randint(1, 9)} >>> 1;", f"    private static final byte[] HEADER = {{(byte) 0x{self.hex(2)}, (byte) 0x{self.hex(2)}}};",
        ])


def examples(seed: int, n: int) -> list[str]:
    """``n`` marked lines; the part in front of \\x1f, if any, is the name of a setting whose text follows."""
    m = Maker(seed)
    out = []
    for _ in range(n):
        k = m.r.random()
        out.append("key\x1f" + m.setting() if k < 0.15 else m.positive() if k < 0.52 else m.negative())
    return out
