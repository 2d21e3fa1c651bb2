"""Rule tables. Fixed values throughout: names, word lists and patterns that results depend on."""

from __future__ import annotations

from treeline.functions.semantics import REFERENCE


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _calls(language: str, rows: str) -> list[tuple]:
    parts = (line.rsplit(maxsplit=3) for line in rows.strip().splitlines())
    return [(language, name, kind, severity, int(cwe)) for name, kind, severity, cwe in parts]


# Dangerous calls by language, with what they are, severity and CWE number.
DANGEROUS_CALLS = (
    _calls("python", """
eval unsafe_deserialization critical 95
exec unsafe_deserialization critical 95
compile unsafe_deserialization high 95
pickle.loads unsafe_deserialization critical 502
pickle.load unsafe_deserialization critical 502
cPickle.loads unsafe_deserialization critical 502
cPickle.load unsafe_deserialization critical 502
marshal.loads unsafe_deserialization critical 502
marshal.load unsafe_deserialization critical 502
yaml.load unsafe_deserialization high 502
yaml.unsafe_load unsafe_deserialization critical 502
jsonpickle.decode unsafe_deserialization high 502
shelve.open unsafe_deserialization high 502
dill.loads unsafe_deserialization critical 502
os.system injection critical 78
subprocess.call injection high 78
subprocess.run injection high 78
subprocess.Popen injection high 78
""")
    + _calls("javascript", """
eval unsafe_deserialization critical 95
Function unsafe_deserialization critical 95
serialize-javascript unsafe_deserialization high 502
node-serialize unsafe_deserialization critical 502
funcster unsafe_deserialization critical 502
child_process.exec injection critical 78
child_process.execSync injection critical 78
""")
    + _calls("elixir", """
Code.eval_string unsafe_deserialization critical 95
Code.eval_quoted unsafe_deserialization critical 95
Code.eval_file unsafe_deserialization critical 95
:erlang.binary_to_term unsafe_deserialization critical 502
Plug.Crypto.non_executable_binary_to_term unsafe_deserialization high 502
:os.cmd injection critical 78
System.cmd injection high 78
System.shell injection critical 78
""")
    + _calls("ruby", """
eval unsafe_deserialization critical 95
instance_eval unsafe_deserialization critical 95
class_eval unsafe_deserialization critical 95
Marshal.load unsafe_deserialization critical 502
Marshal.restore unsafe_deserialization critical 502
YAML.load unsafe_deserialization high 502
Psych.load unsafe_deserialization high 502
Oj.load unsafe_deserialization high 502
system injection critical 78
exec injection critical 78
` injection critical 78
""")
    + _calls("java", """
ObjectInputStream.readObject unsafe_deserialization critical 502
XMLDecoder.readObject unsafe_deserialization critical 502
XStream.fromXML unsafe_deserialization high 502
ObjectMapper.readValue unsafe_deserialization high 502
Yaml.load unsafe_deserialization high 502
Runtime.exec injection critical 78
ProcessBuilder injection high 78
""")
    + _calls("erlang", """
erl_eval:expr unsafe_deserialization critical 95
erl_eval:exprs unsafe_deserialization critical 95
binary_to_term unsafe_deserialization critical 502
erlang:binary_to_term unsafe_deserialization critical 502
:os.cmd injection critical 78
os:cmd injection critical 78
""")
)

WEAK_CRYPTO = ("md5", "MD5", "sha1", "SHA1", "des", "DES")

# What a string literal that holds a secret looks like.
SECRETS = (
    ("password", r"""(?i)password[\s:=]+["'].+["']"""),
    ("api_key", r"""(?i)api[_-]?key[\s:=]+["'].+["']"""),
    ("secret", r"""(?i)secret[\s:=]+["'].+["']"""),
    ("token", r"""(?i)token[\s:=]+["'].+["']"""),
    ("api_key", r"^(sk|pk|Bearer|[A-Za-z0-9_-]{32,}$)"),
    ("token", r"^[A-Za-z0-9_.-]{20,}$"),
    ("secret", r"^[A-Za-z0-9+/=]{40,}$"),
)

# Effects of calls by whole names and by beginnings, the first that fits.
EFFECTS = (
    ("io", _words("print puts write read open input"), _words("IO. File. io: file:")),
    ("random", (), _words("random rand :rand. Random.")),
    ("time", ("erlang:now",), _words("time now Date DateTime Time")),
    ("network", (), _words("http fetch request socket HTTPoison.")),
    ("database", (), _words("query insert update delete Repo. Ecto.")),
)

# Where input comes from, and where it must not go, by language.
TAINT_SOURCES = [
    (language, name)
    for language, names in {
        "python": "input raw_input sys.argv request.args request.form request.data request.json request.files request.cookies os.environ getenv flask.request django.request sys.stdin fileinput",
        "javascript": "req.body req.query req.params req.headers req.cookies process.argv process.env readline prompt",
        "elixir": "IO.gets System.argv System.get_env conn.params conn.body_params conn.query_params socket.assigns Phoenix.LiveView",
        "ruby": "params request.params ARGV ENV gets readline request.body request.headers",
        "erlang": "io:get_line init:get_argument os:getenv",
    }.items()
    for name in names.split()
]
TAINT_SINKS = [
    (language, name, risk)
    for language, risk, names in (
        ("python", "critical", "eval exec os.system os.popen commands.getoutput commands.getstatusoutput os.execl os.execle os.execlp os.execv os.execve"),
        ("python", "high", "compile __import__ importlib.import_module subprocess.call subprocess.run subprocess.Popen os.spawnl os.spawnle"),
        ("javascript", "critical", "eval Function child_process.exec child_process.execSync"),
        ("javascript", "high", "setTimeout setInterval child_process.spawn child_process.spawnSync child_process.execFile require('child_process')"),
        ("elixir", "critical", "Code.eval_string Code.eval_quoted Code.eval_file :os.cmd System.shell"),
        ("elixir", "high", "Code.compile_string System.cmd Port.open"),
        ("ruby", "critical", "eval instance_eval class_eval module_eval system exec ` %x"),
        ("ruby", "high", "send __send__ public_send Open3.capture2 Open3.capture3 IO.popen"),
        ("erlang", "critical", "erl_eval:expr erl_eval:exprs :os.cmd"),
        ("erlang", "high", "open_port"),
    )
    for name in names.split()
] + [("javascript", "new Function", "critical")]

# Word lists of the business-logic analyzers.
USER_INPUT = _words("params request args query body input form data payload get post put patch")
VALIDATION = _words("validate valid? changeset cast schema validate_required validate_format validate_length validate_inclusion sanitize clean filter escape permit strong_parameters Bean Validator DataAnnotation Joi Yup zod")
SENSITIVE_ON_INPUT = _words("query execute run eval send call request write save insert update delete open read file path create new build")
SENSITIVE = _words("delete update insert create destroy save remove modify write transfer send execute")
AUTHORIZES = _words("authorize can? permit? allowed? has_permission check_access verify_access authorize! policy")
FETCH_ALL = _words("all findAll getAll fetchAll toList toArray list")
INLINE_SCRIPT = ("<script>", "</script>", "dangerouslysetinnerhtml", "html.raw", "javascript:", "onclick=", "onerror=")
FETCHES = _words("get get! get_by find find! find_by findById findByPk findOne first retrieve load fetch lookup Repo.get Repo.get! Repo.get_by objects.get objects.filter")
OWNERSHIP = (*_words("user_id owner_id created_by author_id belongs_to current_user owner where user: scope user policy authorize"), "filter user")
CRITICAL_ACTIONS = _words("admin dashboard settings config configuration delete destroy remove purge update modify edit patch create new insert export import backup restore password reset token api_key payment checkout billing subscription user users account accounts")
AUTHENTICATES = _words("authenticate authenticated? ensure_authenticated login logged_in? current_user require_login require_auth session token bearer jwt oauth api_key authorized verify_token before_action plug guardian @login_required @authenticated @authorize PreAuthorize Secured RolesAllowed")
AUTHORIZATION = _words("authorize authorized? can? permit? allowed? authorize! check_permission has_permission? current_user conn.assigns user_id owner policy policies ability abilities admin? is_admin role roles forbidden 403 unauthorized 401 Bodyguard Canada CanCan Pundit")
SENSITIVE_CALLS = _words("delete delete! remove destroy update update! save put patch create insert insert! new Repo.delete Repo.update Repo.insert .delete .update .save .destroy deleteById updateById removeById delete_all update_all")
ACTIONS = _words("delete destroy remove update edit create new index show")
CHANGES = _words("post put patch delete")
CSRF = _words("csrf token protect_from_forgery verify_authenticity_token antiforgery ValidateAntiForgeryToken csurf csrf_protect csrf_token csrf_exempt x-csrf-token _csrf")
CHANGING_ACTIONS = _words("create update delete destroy save insert remove edit post put patch")
SUCCESS = _words("ok some right success")
SPAWNS = _words("create_task run_async start spawn task async future thread goroutine parallel background detached")
QUERIES = _words("all find query select fetch load findall getall findMany where filter")
HTTP_WORDS = _words("get post put patch delete request fetch send")
AUTH_WORDS = _words("auth authenticate authorize permission verify check validate token session login logout sign_in sign_out require_auth require_permission")
TELEMETRY = _words("telemetry emit log audit trace metric record measure monitor")
LIFECYCLE = _words("mount componentdidmount oninit oninitialize mounted created setup ngOnInit get post render load initialize")
JOBS = _words("perform execute process run worker job task handler enqueue background async")
EXPENSIVE = _words("search query aggregate calculate compute export import generate process batch upload download convert transform transcode analyze scan crawl index reindex report render pdf email send sync synchronize migrate backup encrypt decrypt hash compress decompress resize thumbnail watermark train predict inference model bulk mass all fetch_all")
ENDPOINTS = _words("post put patch delete create update route endpoint handler action api controller resource webhook callback trigger graphql mutation")
THROTTLES = _words("ratelimit rate_limit throttle limiter bucket quota limit_rate slowapi rate_limiter Hammer ExRated PlugAttack Rihanna express-rate-limit ratelimiter redis-rate-limiter Bucket4j RateLimiter Guava leaky_bucket token_bucket sliding_window max_requests per_second per_minute")
DATABASE_WORDS = _words("get find query fetch load select retrieve findOne findByPk findAll get! get_by one all")
FILE_CALLS = _words("read read! write write! stream! open read_file read_file! write_file readFile writeFile readFileSync writeFileSync file_get_contents file_put_contents fopen File.read File.write File.stream File.open Path.join Path.expand Path.absname send_file send_download download include require require_once include_once readdir opendir scandir glob unlink delete rm remove copy cp rename mv move mkdir rmdir")
PATH_INPUT = _words("params request args query body input user filename file path name document image upload get post")
LOGS = _words("log info debug warn error warning notice Logger.info Logger.debug Logger.warn Logger.error IO.puts IO.inspect IO.write puts print println printf echo console.log console.warn console.error console.debug print_r var_dump Log.d Log.i Log.w Log.e logger.info logger.debug logger.warn logger.error")
SECRET_FIELDS = _words("password passwd pwd secret token api_key apikey access_token refresh_token auth credential private_key secret_key ssn social_security credit_card card_number cvv cvc pin otp verification_code session_id csrf bearer jwt password_hash encrypted_password")
SQL_WORDS = _words("SELECT INSERT UPDATE DELETE FROM WHERE JOIN DROP CREATE ALTER TRUNCATE EXEC EXECUTE")
QUERY_CALLS = _words("query execute exec run sql raw_query execute_query execute_sql run_sql Repo.query Ecto.Adapters.SQL.query cursor.execute connection.execute db.query db.execute db.run executeQuery executeUpdate executeSql Query Raw RawSQL")
HTTP_CLIENTS = _words("get post put patch delete head options request fetch send HTTPoison.get HTTPoison.post HTTPoison.request Req.get Req.post Req.request Tesla.get Tesla.post Tesla.request Finch.request Finch.build requests.get requests.post urllib.request.urlopen axios.get axios.post http.get Net::HTTP.get RestClient.get Faraday.get HttpClient.GetAsync WebClient.DownloadString http.Get http.Post file_get_contents curl_exec")
URL_INPUT = _words("params request args query body input url uri link href target endpoint host domain callback webhook redirect")
LOGS_OR_RAISES = _words("log error warn warning info debug print println console logger raise reraise throw")
BLOCKS = _words("get post put delete patch request fetch download upload read write open close query execute transaction sleep wait block")
ASYNC_WORDS = _words("async handle_ cast call task fiber goroutine")
# Names that tell a controller, a collection of records, a path or its ending.
CONTROLLERS = _words("controller handler api endpoint view")
RECORDS = _words("user post item record result data")
PATH_ENDS = _words(".txt .json .xml .html .log .conf .cfg")
PATH_NAMES = _words("path dir file folder")
INJECTORS = _words("dangerouslysetinnerhtml html.raw javascript_tag")
MIDDLEWARE = _words("middleware plug handler interceptor filter guard decorator before_action process_request prehandle")
TELEMETRY_CALLS = _words("telemetry metrics statsd emit record increment gauge timing histogram counter execute span observe add inc mark")
# Checks and the uses that may come too late after them, by what is checked.
CHECKS = {
    "file": _words("exists? File.exists? file_exists? path.exists os.path.exists os.path.isfile os.path.isdir existsSync fs.existsSync File.exist? file.exists Path.exists File::exists access stat os.Stat fs.stat fs.statSync"),
    "permission": _words("can_access? has_permission? is_authorized? check_permission check_access verify_access is_writable? is_readable? File.readable? File.writable? os.access"),
    "resource": _words("is_available? resource_exists? connection_alive? is_connected? socket.connected? is_open? is_valid?"),
}
USES = {
    "file": _words("read read! File.read File.read! File.write File.write! File.rm File.rm! File.open open readFile readFileSync fs.readFile fs.readFileSync fs.writeFile fs.writeFileSync File::open os.Open os.Remove unlink os.unlink delete File.delete"),
    "permission": _words("execute perform do_action run invoke call apply"),
    "resource": _words("use consume send receive write read execute"),
}
UPLOADS = _words("upload uploaded file attachment multipart form_data formdata plug_upload phoenix_upload")
FILE_SAVES = _words("write write! copy copy! stream! save save! store store! File.write File.copy File.stream move_uploaded_file transferTo attach saveAs SaveAs DownloadTo put_object upload_file move rename")
UPLOAD_CHECKS = _words("extname extension content_type mime_type file_type allowed_types valid_extension file_size size max_size limit validate_upload check_file verify_file allowed? valid? acceptable?")
BLOCKING = _words("get post query find read write sleep wait block fetch load")
PATH_CALLS = _words("join expand absname relative_to Path.join Path.expand Path.absname path.join path.resolve path.normalize os.path.join os.path.abspath Paths.get File.separator")
SECRET_OBJECTS = _words("user account credentials session auth authentication authorization payment billing card customer config secrets env environment")
URL_BUILDERS = _words("URI.parse URL URI new_url build_url construct_url url_for")
TASKS = _words("async start start_link create_task run_in_executor Promise go Run Start spawn runAsync supplyAsync")
HTML_INPUT = _words("params request args query body input user session cookie form get post put patch delete")
UNSAFE_HTML = _words("raw html_safe mark_safe safe_concat Markup SafeString unescape_html dangerouslySetInnerHTML innerHTML v-html ng-bind-html trustAsHtml bypass_sanitize")

# Fixed values: (domain, framework, pattern, operation, language, target); one pattern of our own after those of the reference.
SEMANTICS = (*REFERENCE, ("external_api", "aws", "boto3.*", "call", "python", "none"))
