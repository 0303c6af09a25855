"""Rules on called names: a catalogue joined with the calls that lines hold.

A call rule says that a function of a language is dangerous to call.  However many such rules there are, a line is read
once: its called names are taken out of it and meet the catalogue in a hash join on (language, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Families of dangerous calls (category, severity, weakness) and the functions that belong to them, by language; our own selection.
FAMILIES = {
    "command": ("Command Injection", "HIGH", "CWE-78"), "code": ("Code Injection", "CRITICAL", "CWE-95"), "unmarshal": ("Insecure Deserialization", "HIGH", "CWE-502"), "hash": ("Cryptography", "MEDIUM", "CWE-327"),
    "random": ("Weak Randomness", "LOW", "CWE-338"), "markup": ("Cross-Site Scripting", "HIGH", "CWE-79"), "file": ("Path Traversal", "MEDIUM", "CWE-22"), "request": ("SSRF", "MEDIUM", "CWE-918"), "query": ("SQL Injection", "HIGH", "CWE-89"),
    "memory": ("Memory Safety", "HIGH", "CWE-120"), "xml": ("XXE", "MEDIUM", "CWE-611"), "redirect": ("Open Redirect", "MEDIUM", "CWE-601"), "temp": ("Race Condition", "MEDIUM", "CWE-377"), "exit": ("Error Handling", "LOW", "CWE-382"), "reflect": ("Code Injection", "MEDIUM", "CWE-470"), "rights": ("Broken Access Control", "MEDIUM", "CWE-732"),
}
CALLS = {
    "Python": {
        "command": "os.system os.popen os.execv os.execl os.spawnl os.spawnv subprocess.call subprocess.run subprocess.Popen subprocess.check_output subprocess.check_call subprocess.getoutput pty.spawn commands.getoutput", "code": "eval exec compile execfile code.interact runpy.run_path",
        "unmarshal": "pickle.load pickle.loads cPickle.loads marshal.load marshal.loads shelve.open yaml.load yaml.unsafe_load jsonpickle.decode dill.load dill.loads joblib.load torch.load pandas.read_pickle", "hash": "hashlib.md5 hashlib.sha1 md5.new DES.new ARC4.new Blowfish.new crypt.crypt",
        "random": "random.random random.randint random.choice random.shuffle random.sample random.getrandbits random.uniform", "markup": "Markup mark_safe render_template_string", "file": "open os.remove os.unlink shutil.rmtree send_file tarfile.extractall zipfile.extractall os.chmod",
        "request": "requests.get requests.post requests.put requests.request urllib.urlopen urllib.request.urlopen httpx.get httpx.post", "query": "cursor.execute cursor.executemany connection.execute session.execute RawSQL", "xml": "etree.parse etree.fromstring minidom.parse minidom.parseString sax.parse", "redirect": "redirect HttpResponseRedirect", "temp": "tempfile.mktemp os.tempnam os.tmpnam", "exit": "os._exit sys.exit", "reflect": "getattr setattr importlib.import_module __import__",
    },
    "JavaScript": {
        "command": "exec execSync spawn spawnSync execFile child_process.exec child_process.spawn", "code": "eval Function setTimeout setInterval vm.runInNewContext vm.runInThisContext", "unmarshal": "unserialize serialize.unserialize yaml.load", "hash": "crypto.createCipher md5 sha1 CryptoJS.MD5 CryptoJS.SHA1", "random": "Math.random",
        "markup": "document.write document.writeln insertAdjacentHTML $.html bypassSecurityTrustHtml", "file": "fs.readFile fs.readFileSync fs.writeFile fs.writeFileSync fs.unlink fs.createReadStream res.sendFile", "request": "fetch axios.get axios.post axios.request http.get https.get request.get", "query": "db.query connection.query pool.query knex.raw sequelize.query", "redirect": "res.redirect location.assign location.replace window.open", "exit": "process.exit", "reflect": "require Reflect.apply",
    },
    "Java": {
        "command": "Runtime.exec exec ProcessBuilder", "code": "ScriptEngine.eval eval GroovyShell.evaluate SpelExpressionParser.parseExpression", "unmarshal": "readObject ObjectInputStream XMLDecoder XStream.fromXML SerializationUtils.deserialize", "hash": "MessageDigest.getInstance Cipher.getInstance DigestUtils.md5Hex DigestUtils.sha1Hex", "random": "Random Math.random RandomStringUtils.random",
        "file": "File FileInputStream FileOutputStream FileReader FileWriter Paths.get Files.newInputStream", "request": "URL HttpURLConnection openConnection HttpGet", "query": "createQuery createNativeQuery executeQuery executeUpdate prepareStatement jdbcTemplate.query", "xml": "DocumentBuilderFactory.newInstance SAXParserFactory.newInstance XMLInputFactory.newInstance SAXReader", "redirect": "sendRedirect", "temp": "File.createTempFile", "exit": "System.exit Runtime.halt printStackTrace", "reflect": "Class.forName Method.invoke loadClass",
    },
    "PHP": {
        "command": "system exec shell_exec passthru popen proc_open pcntl_exec", "code": "eval assert create_function preg_replace call_user_func call_user_func_array", "unmarshal": "unserialize yaml_parse", "hash": "md5 sha1 crc32 mcrypt_encrypt crypt", "random": "rand mt_rand uniqid lcg_value shuffle array_rand", "markup": "echo print printf", "file": "include include_once require require_once fopen file_get_contents file_put_contents readfile unlink move_uploaded_file copy", "request": "curl_exec curl_init fsockopen get_headers", "query": "mysql_query mysqli_query pg_query sqlite_query query", "xml": "simplexml_load_string simplexml_load_file loadXML xml_parse", "redirect": "header", "exit": "die exit", "reflect": "extract parse_str", "rights": "chmod umask",
    },
    "Ruby": {
        "command": "system exec spawn IO.popen Open3.capture3 Kernel.system", "code": "eval instance_eval class_eval module_eval", "unmarshal": "Marshal.load YAML.load Oj.load", "hash": "Digest::MD5.hexdigest Digest::SHA1.hexdigest", "random": "rand Random.rand srand", "markup": "raw html_safe", "file": "File.open File.read send_file IO.read", "request": "open Net::HTTP.get URI.open", "query": "find_by_sql connection.execute where", "redirect": "redirect_to", "reflect": "send public_send constantize const_get",
    },
    "Go": {
        "command": "exec.Command exec.CommandContext syscall.Exec", "hash": "md5.New md5.Sum sha1.New sha1.Sum des.NewCipher rc4.NewCipher", "random": "rand.Int rand.Intn rand.Float64 rand.Seed rand.Read", "markup": "template.HTML template.JS template.URL", "file": "os.Open os.OpenFile ioutil.ReadFile os.ReadFile os.Remove os.RemoveAll os.Create", "request": "http.Get http.Post http.NewRequest", "query": "db.Query db.Exec db.QueryRow tx.Exec", "redirect": "http.Redirect", "temp": "ioutil.TempFile os.CreateTemp", "exit": "os.Exit log.Fatal panic", "reflect": "unsafe.Pointer plugin.Open", "rights": "os.Chmod os.MkdirAll",
    },
    "C": {
        "command": "system popen execl execlp execv execvp", "memory": "strcpy strcat sprintf vsprintf gets scanf sscanf strncpy strncat memcpy memmove alloca realpath strtok", "random": "rand srand random drand48", "temp": "tmpnam tempnam mktemp", "file": "fopen open access chmod chown", "hash": "MD5_Init SHA1_Init DES_set_key RC4", "exit": "exit abort _exit", "rights": "setuid setgid chroot umask",
    },
    "C#": {
        "command": "Process.Start", "unmarshal": "BinaryFormatter Deserialize JavaScriptSerializer LosFormatter NetDataContractSerializer SoapFormatter", "hash": "MD5.Create SHA1.Create DES.Create RC2.Create TripleDES.Create", "random": "Random", "markup": "Html.Raw Response.Write", "file": "File.Open File.ReadAllText File.WriteAllText File.Delete Path.Combine", "request": "WebRequest.Create HttpClient WebClient DownloadString", "query": "SqlCommand ExecuteReader ExecuteNonQuery ExecuteScalar FromSqlRaw ExecuteSqlRaw", "xml": "XmlDocument XmlTextReader XmlReader.Create", "redirect": "Redirect Response.Redirect", "temp": "Path.GetTempFileName", "exit": "Environment.Exit", "reflect": "Activator.CreateInstance Assembly.Load Type.GetType",
    },
    "SQL": {"code": "EXEC EXECUTE sp_executesql", "command": "xp_cmdshell", "file": "LOAD_FILE OPENROWSET", "hash": "MD5 SHA1 PASSWORD", "random": "RAND"},
    "Terraform": {"file": "file templatefile", "hash": "md5 sha1", "random": "uuid timestamp"},
}

#: A called name: identifiers joined by dots, arrows or double colons, before a bracket.
CALLED = r"([A-Za-z_$][A-Za-z0-9_$]*(?:(?:[.]|->|::)[A-Za-z_$][A-Za-z0-9_$]*)*)[ \t]*\("


def catalogue(spark: SparkSession) -> DataFrame:
    """language, callee, rule_id, category, severity, cwe; TypeScript has JavaScript's rules and C++ those of C."""
    rows = []
    for language, families in CALLS.items():
        for family, names in families.items():
            for n in names.split():
                for lang in (language, *{"JavaScript": ["TypeScript"], "C": ["C++"]}.get(language, [])):
                    rows.append((lang, n, f"CALL-{language}-{family}-{n}", *FAMILIES[family]))
    return spark.createDataFrame(rows, "language string, callee string, rule_id string, category string, severity string, cwe string")


def called_names(line: Column) -> Column:
    """Distinct called names of a line, and each one's ends: ``a.b.c`` is also ``b.c`` and ``c``, so that rules meet calls on objects of any name."""
    names = F.regexp_extract_all(line, F.lit(CALLED), F.lit(1))
    ends = lambda n: F.transform(
        F.sequence(F.lit(1), F.size(F.split(n, r"[.]"))), lambda k: F.array_join(F.slice(F.split(n, r"[.]"), k, F.size(F.split(n, r"[.]"))), ".")
    )
    return F.array_distinct(F.flatten(F.transform(names, ends)))


def match_calls(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines (with language) times the call rules they meet: the lines' columns, rule_id, category, severity, cwe; each rule once a line.

    Null lines and languages meet none; columns of the lines that are named like the rules' are replaced.  The catalogue is
    a constant of a few hundred rows, hence the broadcast.
    """
    rules = catalogue(lines.sparkSession).withColumnRenamed("callee", "_callee")
    own = lines.drop("rule_id", "category", "severity", "cwe")
    names = own.where("language is not null").withColumn("_callee", F.explode(called_names(F.col(column))))
    return names.join(F.broadcast(rules), ["language", "_callee"]).drop("_callee")
