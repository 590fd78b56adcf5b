"""English words by frequency, most frequent first; a word's place is its guess count.

From 18,651 documentation files and Python comments of installed packages (distinct by their first
4,000 bytes; .rst, .md, .txt, .html and .py), each file's words counted once: words of 4 to 20 letters,
lower case but for the first, that stand in 5 files or more; ties by alphabet. Names of their authors
are words too.
"""

WORDS = """
this that with from when will should used file have only which name return test code default also class string using
python list module there check value other function make object some more does none first same true version into then
must returns without after case these type because https error need given create like here than just they before call
tests since method doesn note instead line path data number text where support values false each files current them
been both called copyright argument example empty directory work following details always sure would import names even
either otherwise time output order source different raise http exception arguments under instance license specified
want issue what command found available user already result such single functions about uses start objects passed pass
being package still windows multiple self methods returned strings possible contains while their ensure defined format
change most remove mode optional read between whether valid options input created copy match avoid find original
implementation above handle part running provided process needed last build information include cannot added works
calls message could through base root another allow option specific write tuple next fail back errors standard
environment types invalid were once system over based special else variable characters those done documentation raised
args directly second ignore long attribute context cases versions useful well bytes header itself until raises
interface exist except print calling your means character within actually currently might contents required removed
simple expected supported setting full point containing testing section local changes encoding block reference
behavior explicitly various size state skip open content many defaults attributes contain including internal lines
install fails additional modules below keep unless main require filename least allows library during something left
never style global exists description take present classes right configuration again common usage later cause update
dict written anything flag existing keyword complete generated correct compatibility script access times index
sequence table parameter look rather extra form level link title necessary nothing variables included correctly
release makes normal however override provide prefix body tree packages convert results installed needs parse
automatically parent length dictionary ignored very things takes checks every loop close provides unicode clear around
handling named keys generate range software custom gets display know similar entry made missing previous requires
parameters verify paths actual matches modify config instances binary replace allowed node really longer warning
exceptions changed platforms cache request inside syntax search relative help buffer prevent creating working target
against regular supports items width mapping team sets parsing checking properly constructor integer subclass server
matching appropriate project float commands users specify exit much event future place stream everything show though
zero literal comment real child equivalent define give basic includes param space location better helper info runs
numbers licensed enable program separate attempt meta able probably status platform initial exactly extension item
boolean control failed creates memory determine corresponding writing directories page public known adding particular
enough assume less systems field stop break closed trailing load failure handler happen wrong operation shouldn html
terms report starting head general points deprecated lists href accept send distribution simply protocol modified
appear reading whitespace examples passing property related implemented returning thread enabled generator issues
parser implement limit doing references assert repository null pattern callback store tuples messages explicit color
nested associated good effect flags handled console apply fixed immediately pygments depending logic reserved having
imports save func charset underlying comments equal updated outside several three iterable fields wait entries
position structure starts usually adds rights reset namespace according making response happens supplied address
disable split free requests unix elements leading client replaced setup built absolute array yield didn fill headers
socket byte large parsed wrapper count expression reason connection stored expect delete converted installation
maximum spec crash stack problem span trying subclasses certain force alias inherit likely private dependencies
implements behaviour thing representation resulting shared temporary callable metadata small possibly whole compatible
filter please imported operations operator executable debug move spaces encoded received newline perform registry
broken group normally intended follow properties linux arbitrary configured down mark notes document conditions
scripts considered fixes requested clean exact thus entire parts manager ones whose bool element loaded distutils
interpreter depends disabled language looking further causes looks notice final branch features followed checked
definition implementations aren overflow docs dependency bash others port stdout treated rules hash older compiled
token traceback representing strip wrap best repr stuff important statement prior algorithm sent sometimes application
shell generic previously handles problems specifying edit leave performance proper indicates signal together short
specification permission subject taken extensions host compile described safe timeout suite double individual occurs
therefore functionality compare addition rest updates accepted execute turn legacy scope beginning catch detect tell
trigger conversion produce resolve processes negative random earlier purpose side active accepts along going copies
typically comparison execution escape tested insert direct synopsis settings warnings author iterator continue builtin
processing pair seconds unknown fallback unique sort feature finally height defines executed signature strict appears
date caller folder consider padding sorted exec specifies merge descriptor overridden recent resource utility action
constants bound changing care init select construct easy security larger remaining auto occur restore tries keywords
indicate deal links gives printed border ends pairs come invoked initialize regardless represents backwards twice
difference meaning started const threads append deleted events optionally skipped window omitted complex fall follows
bits punctuation backward manually undefined across upon builds extended development internally track core copied
collection condition consistent external native sense compiler extract bugs closing filenames refer async relevant
duplicate fetch password patch listed publish generally hook terminal cached building formatting hello lookup query
register offset debugging ways wrapped distributed plain apache marked runtime unit derived step total creation caused
view foundation fully lower readable stderr assumed depend whatever minor cleanup getting separator kind tools
identifier validate sequences frame remote word applications early alternative decorator mechanism static aliases
coding words amount away filesystem kwargs account contributor successfully regression codes abstract contained
permissions world scheme maybe char easier resolved configure switch resources treat ever greater lock prompt comes
completely registered resolution validation installing numeric affect often replacement tags iteration semantics
commit subprocess fast network applied underline suitable tokens indicating rely sources apple blank applies embedded
subsequent globals purposes success blocks removing cycle documented home locale requirements limited invoke seems
interpreted lexer role authentication initialized anyway archive normalize json recursively disk throw encode master
partial patterns reads reported slow opened convenience formatted determined pipe minimum waiting docstring identical
quotes record recursive requirement assigned background plus recursion becomes little margin opening recommended
allowing represent seen expressions logo ensures member regex fact decode executing positional unlike reasons removes
proxy published become incorrect magic processed streams introduced receive rule formats latest libraries children
implied although desired compute definitions preserve readline failures guess operating generates latter writes
specifically hard integers ready utilities major sending symlink whenever goes handlers logging hold differences
guaranteed releases hack newlines domain especially history shows moved reporting strong drop granted loading
overrides helvetica tool arial exported providing retrieve suppress statements completion kept sign footer higher
attempts garbage lang neither smaller idea think inherited leak unchanged connect converts optimization faster linked
reverse importing assignment coverage displayed raising begin pointer template unexpected choose highlight push queue
share silently infinite produces programs distribute machine separated workaround quite agreement components newer
shutdown chain chars sanity task members passes prints suffix await selected detected finished symbols wasn installs
produced reduce reports chunk component matter places summary join monospace saved fine meant quoted session column
performed supporting third preferred dummy implicit interactive assumes holds respectively email keeps people quote
succeed visible supposed callbacks mean positive almost courier literals forward successful trace codec ignoring
matched modification mono prefer warn middle figure stdin subset themselves dual emoji hooks hover iterate priority
symbol assuming caught decimal descriptors exclude isinstance shown terminate wheel banner potential inspect replaces
forms lambda appended flush solid comparing manage failing perhaps versionadded pages calculate expand ffffff finish
usual completed blocking triggered unittest username writable align browser expects ending setuptools accessed
filtering precedence attr destination mock taking lexers pick polygon menlo attempting someone diff indent nice
binding consolas consume marker structures alive minimal delay digits guarantee site breaks inner unsupported export
label temporarily wants high unused dependent necessarily pathname actions debugger defining operators params
represented speed wrapping builtins constant detail escaped hence pending emit liberation occurred addresses database
designed evenodd generating groups mostly currentcolor dddddd enables logobar potentially rainbar segoe canonical
easily encodings eval folders connections pretty pure slash generation expanded overriding steps updating workspaces
reasonable tracker beyond entirely extend giving prevents avoids maps released typing causing exits origin encountered
owner repeat inputs maintained operate printing google implicitly compared emitted download environments hereby
exercise loader pack prepare pull timestamp anymore closes implementing reached replacing combination combinations
progress course nodes obtain boundary decoding auth extracted indentation ascii conflict fork hidden automatic family
initialization model super symlinks decoded factory finding identifiers limitation specifier sockets connected meth
virtual asynchronous experimental ints redundant additionally constructed depth dynamic outputs container rename
hostname slightly tells vars verbose cancel lead sample says clone bind usable alternate race unfortunately
unnecessary yields manual service situation collected recognized portions posix remember significant eventually
terminated abort exposed menu soon assertion colors destroyed levels spawn states policy accessible caching equality
four hope ignores normalized approach independent newly channel incorrectly maintain deleting detection preserved
stripped worker incomplete tabs pickle selection signals stable collect wish copying deprecation inserted past assign
editor elsewhere lowercase sizes circular interfaces refers startup adjust capture center cursor dicts front languages
locals sends signed transport attached behave hasn overwrite selecting struct bindings distributions limits presence
truncated leaving framework saving blocked compilation enter loops practice threading typical certificate chunks
redistribute servers symbolic controls distinguish portion remain repeated similarly transform breaking computed deep
dynamically frames interesting tracking tried wraps affected improve ranges separately tasks bgcolor escapes fake lost
relies buffers ordering permitted identify invocation stores describe developer helps located reuse upper applicable
held importlib records supply listing referenced respect safely colon duplicates indices lets cleared combine concrete
convention cover invoking placed solaris union incompatible thanks converting formatter keeping machinery stops
comparisons helpers indented optimized warranty determines kernel knows locally situations subdirectory asyncio
backslash detailed parses stdlib anaconda bogus round white affiliates chosen inline loads person propagate slice
translate widget grammar haven seem segfault shall strictly button combined differently variant documents thrown comma
javascript shortcut ordered succeeds behaves contributors discard dist modern render requiring strategy coroutine
engine redirect sync vlink bare binaries careful decorated displays floats indicated lazy modes accessing cycles
generators receiving reject corresponds errno letter obtained tarball collections declaration primary promise spam
authors consists decide exports restriction sections unable among columns scan cleaned counter developers management
multiline payload targets cancelled backend checkout consistency counts couple dots instantiate originally outer retry
screen submit effective filters remains responsible universal begins glob merged mixed obtaining overhead quickly
design exiting separators showing parallel somewhere compressed dump projects runner uninstall urls choice edge
resolving retrieved routine stopped ability basically bottom markers npmrc acts illegal initially kinds searching
bypass declared device font hand packed slower solution temp term tracing unsigned evaluate existence post affects
buffered finds graph resolves responses transfer buffering feed leaks linking optimize pool throws consumed effects
hopefully interaction makefile peer pieces renamed verification executables expansion express immutable macro
modifying unset annotations aware describing programming turned arrays conflicts destroy involved series submodule
complicated indexes instantiated legal recognize reload removal retain rich sufficient trivial behind chance
docstrings drive fragment increase onto production stylesheet turns ahead altogether doctest expose reader
constructors moving pickling preference upgrade visual walk worth year anywhere ensuring identified manner mutable
protect skipping compiling discussion hang partially patches permit prefixes trick understand leaves notation wanted
forget omit preceding primarily slashes storing translation zlib dictionaries former kill went backslashes compression
happened particularly restart util void applying asked hierarchy pointing quick disables efficient limitations mapped
overwritten bunch clients mistake weird impossible lineno locations namespaces prefixed proceed seek simulate forces
localhost naming simplify triggers workspace architecture bytecode conda configurations highlighting mainly alone
attempted caches excluded idle satisfy sorting whereas continuation differ identity appropriately attach concurrent
construction elif expensive instructions possibility theme brand conditional dialog effectively getattr moment dirs
forever locate marks period bold compliant discarded echo intermediate modifications rare candidate conflicting
counting duplicated enum looked merges piece refs reproduce sensitive calculated hide official precision recently
simpler substantial advance downloads fresh handy infinity iter math parentheses power quoting sleep transparent
completes searched spurious verifies accordingly convenient crashes highest integration lack prepared protocols
serialization unavailable area commits constructs contact deps describes somewhat translated correspond datetime
evaluated instruction routines subdirectories wouldn acceptable decoder fetching helpful inherits issued layout perl
positions rewrite timer advanced brackets corner fairly internals letters mentioned tkinter atomic essentially factor
moves reach reliable styles tricky adapted archives executes instantiation opens redirected repo undocumented xmlns
flow inheritance iterators profile sentinel stability annotation digit holding incoming intentionally late performs
prune rejected stat category configurable governed lots reused shorter specifiers valign alink charge malformed
mappings multiprocessing obsolete worked filled maintenance miscellaneous navigation retained segment underscores
anyone browsers consult exited explanation live sensible timezone typed unspecified allocation compress contexts
customize downloaded introduction persons publishing searches signatures standalone submodules belong bytearray digest
increment macros mypy qualified unlikely whom allocated bundle commonly lesser logical operates predicate receives
restrictions said scoped serialized suppressed alter alternatively appending cellspacing indirectly invokes lengths
login okay stay unpack variants alpha attrs bother cellpadding frozen guide human inspired jump logs prepend proxies
sublicense algorithms duration github portable technically truncate altered bundled covers floor managed overall
repeatedly risk subcommand unpacked accepting branches controlled guard inconsistent locks offsets scheduled vary cert
coming dropped effort hexadecimal interpret populated recurse sell tables trees underscore changelog distinct extras
interrupted manages mismatch selector came cell consisting couldn covered dead everywhere identifying improved layer
longest manifest mtime rebuild toggle wide wildcard deletes enforce furnished interrupt machines revert gone
guarantees timing wake advantage answer cygwin deadlock finder grep hashable hashes unconditionally unrelated bounds
excluding logged mail pointed restricted schemes uppercase clause constructing defer icon interval mess opposed
recorded relatively touch accidentally directives editing expecting identifies metaclass nonsense prompts regarding
timeouts travis unpacking weak wrappers wrote ambiguous constraints containers conventions crypto ctypes introduce
regrtest click differs fetched fixing indicator reflect semver upstream assumption dealing image milliseconds mixin
rewritten secure segments basis confused minus nearest schema surrogate tail consecutive corrected daniel delimiter
emulate meaningful ourselves relying resets variety exclusive extends favor globally internet obvious persistent
friends half honor normalization simplified slot specially square tracebacks verifying zeros allocate cast clears
foreground parents rebase captured clock commas endpoint introspection inverse labels linker merging patched phase
undo claim despite entered product secret substitute unaware unsafe urllib writer argv asking compliance implies nbsp
quiet registers robust wheels confirm confusing equals maintainers poll rendering dotted linenos logger opts safety
scopes afterwards darwin deletion escaping falls forbidden iterating markup nesting shallow substring synchronous
terminates callers colspan editable functional manipulation michael quit splitting weakref activate anchor days green
iterables traditional triggering annotated computing direction fewer flat listen mask minutes pipes reversed told blue
bootstrap credentials dark david ended entity goal hint near notify question subclassing submitted trailer acquire
apparently bases difficult downloading lookups remainder retries visit waits benefit critical cross delimiters
established functools hosts huge impact inserts launch ordinary rows serve stub tagged terminating zipfile compact
complain english heuristic listening mechanisms mutated plugin putting schedule worry certificates conform derive
disallow exhausted focus microsoft paragraph resume revision shift statistics textual timers circumstances disallowed
expressed listener octal spawned storage unregister visited aborted authorization channels contributed declare
decorators insertion interested involve obviously prog saves yourself classmethod compares corrupt heap intro preceded
puts transformation years yielding customized delta deprecations eliminate evaluation floating guidelines lifecycle
prepended reliably satisfied serves sharing dispatch freed initializes outdated registries rendered restrict somehow
verified adjacent cancellation configs contributions emits falling guido highlighted immediate month studio
subcommands additions boundaries chapter deliberately epoch exposes fifth gracefully hasattr honored installer signs
toplevel buggy endings great happy opposite registering rounding website analysis basename buildbots combining
communication disabling discovered displaying division establish exceed foobar interpretation managing matters
performing respective specs sysconfig workers avoiding communicate completions directive embedding fileno insensitive
lose packaging pathnames presumably provider redirection shorthand silence streaming tempfile typo android catching
compat determining heading ideally occurrence primitive refresh sdist specifications transformed welcome zone
connecting cookie dangling deprecate eggs ideal inclusion mozilla roughly subtype assertions asynchronously boston
filtered inclusive locked noted procedure rarely reasonably region substitution daemon hints overwriting populate
presented shape skips specialized trust upload backport collector descriptions entering exceeds fatal flushed forced
interact italic java leads overlap overview parsers prototype refactor subclassed associate black broke concatenation
detached deterministic fixer manipulate placeholder processor restored rtype achieve addons anonymous callables
challenge clearing gzip improvements notable pointers problematic regexp resolver simultaneously stripping unhandled
units assumptions diagnostics divide eric fashion gather grab handshake likewise lowest mandatory marking nodejs
subtle unnecessarily adjusted concatenated enumerate explain measure mind products traversal warsaw yielded adduser
agent alignment alongside attacks inject naive preserves protected protection tbody triple weren accurate buildbot
choices computer consumes declarations delimited finalization gave gencodec hardcoded indeed interfere modulo natural
nature occurrences pertaining producing redirects repositories responsibility treats assigning barry beta emulation
extraction facility fraction integrity lacks lazily loose managers recv reduces strange surrounding unlink attention
collecting compiles defaulting engines entities hitting infer interior invariant opener repl unbound varies viewport
believe closure computation jython misc ugly alphabetic assignments carefully dest detects knowledge lives preserving
promises randomly reflected strips suggested transforms bracket caution classic cleaning cyclic encounter flattened
forcing informative mention minimize mutate optimizations propagated simplest tracked accesses apart appearance carry
cluster definitely hangs hashing learned notified offer pathlib sane serialize singleton standards topic useless
absent braces bump chrome consuming customization dates dirname extracting extracts extraneous face heavily hits
independently involving mixing modifies popen respond sorts subprocesses swap validated widgets delegate fancy keyed
plugins redistribution refuse silent throwing bigger chaining dashes decodes disclaimer inspector ownership
parenthesis purely readme versa vice alternatives conjunction consistently cost expr formatters historically idlelib
libc oops promote pytest resize succeeded superclass uncompressed validator audit candidates debian forwarded
fragments hour initializer issubclass leaked parseable pascal referring suggestions tokenize vector capabilities
contributing cope corporation corrupted destructor imply isolated keyboard ought ports preventing requesting strongly
towards validity worse blob dgram explaining fault filling importable interest internationalization joined loaders
parens play stale vertical avoided continued coroutines ellipsis flatten indefinitely intent leaf maintaining mimic
printable seeking suffixes throughout unmodified arithmetic blow breakpoint calculation chunked clarify community
concept constraint cookies distinction extending foreign glibc instantiating needing numerical popular rejects rewind
separating thought transition trusted viewer connects expands flexible folding frequently intact literally multipart
notification predefined reaches referencing significantly terminals timed appends became coerce commented compilers
dedicated delivered enclosing finishes franklin gotten memoryview organization outcome patching restores tarballs
timestamps virtualenv acquired arrow capability capturing collapse continues conversions discover emacs inserting
iterated learn lone mouse netscape nonlocal party pause pickled prev readonly renderable theory asserts closest
contrast decided dedupe finalized inheriting matrix nobody physical pretend querystring smart suggest watch whichever
belongs efficiently expired formerly happening invocations linear pydantic queries referred seeing signing activated
delayed edited encrypted examine expires five freely libxslt padded propagation recommend scroll sequential stuck
subsequently templates venv absence arrange bring cleanly deferred domains evaluates extremely fullname futures
increasing inferred killed malicious mutating namedtuple nasty opcode paste relied scenario subtract suites tolerate
trio vinay advertising badly codecs enabling exceeded finalize frozenset hostnames materials preprocessor punycode
scale solve spelling stdio surprising trouble unreachable catches certainly clearly complexity comprehension computes
consist corepack intl miss obscure opcodes pyproject recognizes semantic switches gitweb james joining markdown
precise programmatically rossum sajip scanning wild checker commercial correctness exponent grouping harmless
informational involves largest merely practical primitives refactoring registration relationships scanned treating
cells encoder filesystems fits fold indexing indication introduces leaking mailto mirror raymond recreate regexes
replacements silly slicing straight thomas ubuntu validating vulnerability week workflow authority besides chained
codepath configuring consumption continuing controlling dangerous deeper detecting expanding fixup friendly grant
horizontal inspecting john nonexistent reduced shells sindre smallest sorhus stage statically suppose switched
termination terminator umask unneeded unquoted unwrap veillard doctests drain dumps embed embedder emitting fractional
funding homepage infrastructure lxml opaque prevented publicity relationship sudo sufficiently surrogates switching
synchronization took traverse treatment chdir dash dirty enclosed excludes life modifier packing possibilities sees
sessions simplicity sizeof snapshot structured walking xcode abbreviated atexit bufsize depended diagnostic dumb
forgot hours incremented initializing injection lemburg notably numpy owns reflects representations review subscript
translations turning verbosity agreed apps brian cancelling checksum closely crashing desirable distro finite indirect
menus pager retrieves splits syscall taught thereof tokenizer unlimited unusable whitespaces april arch aspects blame
borrowed categories compound expectations fonts july light owned recover resulted rsquo slices star adapter addr
availability blanks capable decompress descendant endorse furthermore gerhard getter gettext installers itertools
january redistributions reply sides slots stash stats threshold uncaught wasi agree aligned architectures
backslashreplace cloned closer confusion dataclass dedent flushes historical indexed installations lifetime lowercased
nicer nonzero poor pressed prime pushed respects rounded satisfies sock spawning understood webcrypto accidental alert
appreciated bitmap breakpoints chmod claims conn contribute environ interactively iterates loss pyshell querying
questions queued richard selects sibling substitutions suggestion supplying tied trip unpickling validates accesskey
blah builder clobber converter creator deals dialogs draw drops encapsulates importer launching postinstall roundtrip
seed shadow shim showed shrinkwrap verbatim wildcards accumulate approximate arglist duplication existed feedback
fragile fund harder manipulating oldest openssl picked portability prerelease pushing ratio refused samples tracks
unwanted ambiguity arising backtracking clang collision continuous decision develop explore flaky htest iterations
jobs liable normalizing occasionally omitting picker plan preparation refuses regenerate scenarios scheduling
technical threaded totally uninitialized unreadable versionchanged adapt arbitrarily business bytestring
communications explained hardware increases injected junk linecache looping lundh maintainer models observed policies
resetting restarted spacing stated webstreams zipimport annotate atom authenticator booleans bruno buttons comp
deliver delivery enhanced fixture hyphens launched malloc monitor outgoing overwrites passwords preinstall prereleases
prod rate readlines scalar serif solely staticmethod synchronously truly understands unittests visibility weight
behaviors cipher coerced cython digests disappear driver elapsed extent familiar fredrik globs hierarchical
incremental inefficient interacting mutually ninja pathspec preferences queues reentrant shortest snippet technique
texts today unrecognized unusual vulnerabilities weakrefs workflows authenticate boxes certs creative efficiency
enters everyone feel inspection maintains mkdir overlapping physically refcount sender shims synonym tutorial
variations volume waiter accuracy asks average bail batch bounded brief choosing discovery encounters exchange
facilities highlighttable highly invalidate jumps mistakes newest normalizes refactored repeats resort semaphore
shebang shutil sized stick straightforward trim unfortunate zeroes acknowledgment article bypassing captures clearfix
comprehensive concatenate damages desktop devices finalizer guessed improves interpolation localized modifiers narrow
patents peter pilgrim reusing saying setter tips transaction unbounded unhashable upgrading amounts argparse breakage
coercion concurrently consumer demo enforced fedora identification improvement indents integrated ipython irrelevant
killing libcst macintosh maxsize months nick permanent peters predicates prove provoke pseudo pypy realm renaming
repetition shipped soft substituted tabindex waitpid achieved ancient central confuse credits developed encryption
essential exponential flushing forked forth highlights individually inst intention leftover lookahead mailing
nevertheless notices packaged picklable pylint realpath restoring trap tweak unary unbuffered uniformly apicontent
apidoc attack baseline blindly bypassed collisions descending edges evaluating externally fourth governing gtoc lato
leap martin minute mmap perfect press proto publication redo renders sake seekable semaphores serving till traces
truth ultimately unescaped wink absolutely ancestor capacity clarity corruption decompressed equally excessive
exercises experience handful letting offline oudkerk pressing reachable satisfying sparse successive tmpdir uniform
untracked variation vulnerable activity aliased cloning comprehensions considers counted dataclasses enctype
erroneously excess fffacd fileobj inform isolation karl kwds linenodiv lint nearly ordinal overflows predictable
semicolon talk telling testfilename traversing vendored verdana wiki xsldbg bars browse calculating composed curl
demand diffs downstream estimate facilitate fnmatch hanging harness limiting locales mocked oauthlib offers plainly
programmer publicly representable scratch scrollbar shut simplifies somebody topics vendor whoami abstraction
addressed allocations appearing barf caveat colons conservative deepcopy deeply disconnected doctype draft eliminating
feeding filepath flavor haible holder innermost integral kwarg logically migrate misrepresented packet persist
recording stopping stubs substrings talking teams thousands vectors watcher widely wider allowable alphabetically
backup benjamin calculates calculations collects considering consumers credential criteria deemed denied ditto
executor forking gathered increased insecure intel june kills licenses listeners microseconds mutation printf proc
reaching reconstruct reflog repeating serial serializer services shortcuts sole stars stmt thorough views abbreviation
analogous complains concerned coordinates expectation fractions hashlib ident infinities lstat march november
permanently popup principle shares shorthands testcase tiny translating truncation untouched advancing badge casing
cleans codepaths concurrency december defaulted eagerly exclusion exitcode formed frequency illustrates intend
interpreters jedi meet plat precede queried respected retrieval revealed roots strftime traced truncating uname
unfinished upgrades versus appendix beware blockquote carriage chains clobbering conforming contiguous cyrillic denote
distance enums fair flexibility imagine interactions leftmost maint mistakenly naturally netloc pipeline rejection
releasing sampling sendfile sphinx spread steven styling surrogateescape tick todo unified unlock wire aborting
accessor addon andrew august benchmarks brace cancels coded collapsed colored completing died driven easiest endian
endpoints enhance exhaustive httplib idempotent licensing measured nest nicely notebook percent proceeds profiling
pushes pysqlite quot readinto revised rollback segmentation suppresses swallow synchronize thin transient typos
usability abcd accumulated actively adequate adjustment attachment christian classmethods codebase comply confirmation
demonstrates february fsck incrementing integrate issuing jaraco lodash mimics mirrors news noticed occurring
overloaded pickleable ping plural positives pyconfig resumes room scripting secondary sites stateful subsystem thinks
urlparse validators waited wins appeared authenticated benefits bins checkers comparable deallocated defect
equivalents funny gzipped interfering labs lambdas lockfile locking losing mainloop mike pops privileges probability
prompted rationale reopen rough route spans traffic uniquely unnamed wishes ansi backported belonging benchmark
ciphers clever counters decides decimals erase exposing freeing fstat getaddrinfo grow hiding isolate legitimate libuv
marshal material noise noop paul peek piping presentation rebuilt recommendation retried reusable robert scrolling
subsection texinfo themes transmission unaffected unions versioning visitor warns accommodate alphabetical ascending
automated barrier busy clicking clones cocoa conforms consequence disallows ephemeral evil expansions fastest freeze
hoisted imaginary installable japanese metaclasses mime mocks mutex nnorwitz pinned pkgutil ported providers pypi
redirecting resized selectors spot subinterpreters subtree teardown tilde transparently uncomment unexpectedly
upcoming walks anthony bootstrapping chances conduct cumulative discouraged drives dropping exclusively fire flist
folded forks frees friend gain geometry jonathan lexical matcher misleading mocking mount offending opportunity
ostensibly packs periods permutations plaintext preparing propagates pythons renames reverts safer segfaults speeds
stages topmost analyze ancestors anchored annoying boilerplate bugfixes compose concat crashed damage dictates
disconnect eslint expat grouped implications increments indicators lenient lies listdir media membership
multiplication namely normpath ntpath perf perspective powerful profiler pulled pydoc reducing retrieving rotate
simulated spelled srcdir stringify unconditional undone unquote utils violation worst acquiring alex becoming berry
canceled chromium clipboard collaborators cpython curve directions distros ecosystem expire finders fixtures
functioning ideas initialise inspected introducing monkey multi noisier outlined paired pixels polling practices
precedes preferable preload react readers recommends recursing reinstall repack retrying revoke ruby segfaulted smoke
sourcecode specifics subdir subinterpreter suffer toolkit transformations unordered whitelist writelines abspath
adhere admin alarm attacker caret catalog checkbox completer cons consequences datagram divided editors eliminates
falsy fills hurt initiated internationalized jeff knowing loadable loopback lsquo maximal mentions monday nargs
natively negotiation noqa onwards operand overly paused prohibited quality recovery regressions reproducible
reproducing sentence setattr shorten simultaneous sits someday symlinked triples upgraded whence affecting auxiliary
bisect cares conditionally continuations cryptography daylight deciding delegated demonstrate descendants descriptive
deviation drawn enhancements fallbacks favorite finishing forbid granularity greg hebrew hettinger heuristics hosted
initialised julien largely libexslt libs longs loses nonempty numbered orphan outfile overridable percentage popped
pprint pragma receiver regard reloading reprs runpy scrolled severity sheet shlex shortened simulates smarter starred
subtypes terminology abbreviations accurately asyncore augment autocompletion began bypasses clash collaborator
composite coordinate deadlocks dies emulates endif enumeration extreme inplace intervals jack latin mbcs moreover
plist precisely precompiled programlisting proposed setdefault signify sunday tooling truthy typedef unclear unscoped
urlopen wakeup winter acknowledging advertised advice alphabet approximately arabic bodies calendar combines
completeness cruft delegates designated detach disambiguate discussed encodable environmental examined incorporated
isatty keybindings meets october officially outermost paragraphs parenthesized plane preprocess pyparsing recipients
reporter setstate sleeping steve thinking trailers tricks underneath unstable unwrapped woken worktree yellow accident
attaching backends binascii broadcast bugfix canvas clearer clicked contribution credit datatype declares diagram
dispatched emscripten encodes extensive generics inappropriate incompatibilities larson launcher lightweight listens
mismatching movement multiply octet omits overload packfile paren pixel placing population prepares qualifier stand
stefan strategies stricter subscription superset targeting theoretically transferred transitive turtle waste websites
abruptly aims audio casting committed compressor consideration ctrl decoders decrement endianness ensurepip fetches
figures greedy gregory grows hyphen idiom interoperability julian justify learning lionel mergetool mitigate modeled
notifications notion occupied olaf optimal personal piped pythonw qualify quux relating resizing roger score sendall
shuts silenced speaking stray subpath subscribe tokenized touched tqdm weeks xslt yarn advisory aside bachmann binds
brought capital curly curses dave declaring deny deque divmod erroneous exporting extensible flagged getters importers
insufficient interrupts ncoghlan placeholders pointless processors quotation recipe responds returncode reverted roll
sophisticated stays stolen substituting subversion tabsize transports troubleshooting tunnel tweaked userinfo varargs
wind writeable abcdef adjusting armin arrives artifacts awaitable backed caveats collin contrary eager eight
encouraged faulthandler identically interpreting josh kevin keyring macosx medium misbehaved mismatches mutates nowrap
parties phrase powers proxied purelib readability reality refleaks regularly reraise respecting rightmost serializable
ships shrink smith surrounded typeof unauthorized unpredictable userid acquires allocator alphas appname areas arise
assembly backoff bill brown caption considerations decompression decorate denominator deployment diagnosed duplex
edits fname graphical images impl inconsistency initiate insane interprets intervening inverted logout msvcrt printer
recycled refcycle reloaded rewrites rounds salt samp serializing served slate speedup subparts superclasses syntaxes
tarfile translates unambiguous unintended unlinked weekday willing addressing altering andreas aqua aspect
autogenerated bdist book bureaucracy clobbered concerns coro counterpart crude databases deallocation decodable
degradation delegator encourage factored funcname fuzzy goodbye highlighter impose improperly intentional loosely
measures missed needless negate octets optparse packfiles performant periodically posted postfix prefixing redefine
redirections reformat roman selections separates spent stronger suggests syntactically tempdir usages violate warned
yanked adjustments advantages anchors approaches arises augmented basics bookkeeping canonicalized cased cheap chooses
colin coloring colorizing costly counterparts defs formula fortunately generalized grey groff hacks heavy honors
incrementally inheritable insist intercept invert labeled memo multibyte mutual noordhuis obsoletes owners plug
prepending prioritize races rational restarting retains sans semicolons shutting signalled singletons sound spell
stress successor teach textwrap thereby tobias tweaks typofixes underflow uuid variance verb visiting wherever writers
xsltproc zope accounts activating adapters arrive atoms backing backspace backticks blog bootstrapped bulk calltip
checkbutton checksums circuit conflicted customizations deduplicate derivative deserialize directs docbook downgrade
ease edition equivalence errored exceptional execfile exercised expiration families fired fish forcibly formal freshly
goto greatly greeting inconsistencies iteritems mangled messy midnight msgid nathan obey online optimizing orders
packets partly platformdirs positioned prompting pruning recompile refreshed streamed subtraction suit superfluous
supplies survive suspended toggled trimmed unambiguously unify vagg variablelist vertically wording advertise
aggressively bradley carried chown clarified compromise deactivate decremented destroys dimensions dists factors
focused freezing greek hardlink instruct jansen justification latency measurement million mimetypes pasted picking
pkgname poorly posting prerequisite priorities pruned pyver remotely repair restarts retaining serious solutions spend
spinner stacking stands strictness subsets sugar superproject symtable tend testable testcases tiger timeval
transmitted unblock uncommon unicodedata unmatched unparsed untranslated uploaded zombie zones acceptance accomplished
adopted adoption anna basedir checkpoint circle classdef coffee conceptually curious dawson demonstration dependents
descend differing divides enterprise filelist george getopt graphics hardcode hoist ignorable improving inequality
insists intuitive jason linter localization locating mailbox multithreaded needlessly nonce normalise occasional parso
pickles popping relax remembers reparse repetitions restrictive resurrect signaling solves steal stephen styled
submitting summaries suspect tight toggles translator turkish unconnected uninstalled zipimporter alphanumeric
alternating anybody behalf bitwise boost calltips chris clauses commandline contribs controller cool ctxt debugged
deflate denial denotes diagnose dialect drawing enumerable exhaust exhaustion forwards frontend grid guidance guides
imposed kernels keybinding land lexicographically locator loggers majority manpage maxlen nagle numbering onerror
organizations organized refusing replicate resumed rstrip sanitize sensitivity sqrt stamp terminators ties timely
tokentype traditionally transmit typescript undecodable unescape uniqueness university unzip vista weights
administrator afterward algo atime autoconf awaited behaviours cambridge carrying catalogs centered correction
cryptographic dance decrypt difflib dlopen doubled emulated flattening forwarding frozensets fulfills gamma german
geturl gitk guessing hacked henningsen importantly inactive inference influence inode intermediary issuer linting
magics manipulated massive mishandled negation nudge plumbing preview randomization rebinding rect regards remembered
resolutions rmdir scrollable sigh slight solved solver spirit stacklevel structs subnormal taylor testsuite threadsafe
transitions tuning unpickled widths xgettext yaml zasso alters anyways approximation backporting blobs briefly clinic
closures computations concepts considerably contextlib contract detector developing discarding duck encountering
examination fear fingerprint footprint forgotten funcdef gabriel gained getstate gmail grandchild helping hoisting
hood hunk icons intersection invisible isaacs memoized metacharacters mkdtemp nans operands outline outstanding
passphrase peers perfectly philip pictures posixpath proof qualname redhat resp revise rewriting scans scheduler
selectively separation setlocale sleeps snippets sticky stupid subclassable subroutine suppressing syntactic tape
tends terrible textview ticket toward traversed twisted unload unpublishing unqualified unregistered viewing weakly
wednesday workarounds zhang zoom abandoned abcdefg accelerator arguably artificial assorted backlog bearer blink
canonicalize classname clicks collapsing colour company concatenating consequently constrained defects destinations
differentiate divisible docutils dumped efforts encrypt epatents feeds fernando fulfilled getfixture glyphs graceful
gray handing instantiates isaac keyfile kqueue lexicographic mathematical matteo memoize microsecond originating
overlapped paint perez permissive pred prematurely presumed proposal quadratic recreated reduction renderer replay
reserve resides revisions rotation scanner shadowed snell solving spellings standardized stringified subfolder swapped
symmetric thank thursday timedelta trash twitter tzinfo weaker xrange accounted aliasing angle animation apparent
arranges blows cflags chinese cleanups collina contrarily country ctime currency deadline decl decompressor
distinguished elaborate elemental examining excellent figuring french frequent grants hacking health incorporates
indirection instanceof interp intervention listbox localize macs magnitude matt mismatched moderate monitoring
namedtuples opinion oriented outputting pane partition picture platlib pollute populates preset protects quantity reap
rebind recipient refleak reflection robin runtimes schemas setters simplifying sorry stock structural subpackages
titles transferring trott truncates ttype undesirable usernames valgrind arcname authorized backtrack bridge bygroups
card certfile christopher chunking coerces colorizer compensate complement contrib craft crazy customizable
customizing defaultdict deriving designation discussions dispatching django emulating entrypoint evan exclamation
executions explains firefox folks forcefully globbing grammars harmful hell heller hides hmac horrible indenting
lockfiles lookbehind manifests matthew maximize memuse metrics millisecond modulus normalised normcase ordinarily ours
overkill overlong paper parity porting premature profiles protecting protections quirk recompute redefined refcounting
relation reorder rerun resilient restricting rolled ruff runnable russian sanitizer schedules seeks serializes severe
sitting slave smalltalk spit standardize stateless subdirs submission subtest tolerant toolchain toolset touching
tracemalloc traversable tunneling turtledemo tzdata unbind understanding unequal unhelpful unimplemented unlocked
unpacker userconfig validations wakes aborts additive antoine associating authenticating autocomplete bumped bundling
capath capitalized courtesy cursors defers difftool digital dimension dispatches distinguishes doubles dragging elem
emphasis favour finalizes fundamental getsockname globalconfig grabbing greatest grok handed hashemi horizontally
incorporate inlined interrupting introspected iterkeys johan joins jordan lacking linefeed linkage localtime lucas
mahmoud manipulates meantime metavar modulefinder msgfmt nbytes negated normalizations opted origins panel
parameterized parametrized passwd persistence preamble predecessor prefers presents programmatic prohibit propagating
proves randrange readdir recall reclaimed recognised recursions regenerated reproduces research restricts resuming
savings schlueter scientific seeds shot significance slowest socketpair socks spawns spite stashed strongest strptime
sublist summarize suspend symmetry tack timeit timings topological training transformer typeshed unborn undefine
unpublish unref untrusted variadic violates wikipedia abandon advised aggregate allocates anytime archs arrows
assemble assigns assure automation awkward ball bundles cheung circumstance cleaner colorama committing compresslevel
concern cond configdialog configures consolidate contextual conveniently crafted crasher decent decrease destruction
devhelp directed discrete docker doctor dollar dotless editables ellipses encapsulated fancier flavors getitem gitlab
guards headings inherently interned investigate ipaddress joshua joyee keypress leader libffi lifted likelihood luigi
masks masse mathias messing misconfigured misuse modular monkeypatch multiplying npmjs numerator originated paging
pasting pinca pluggable pooling pristine programmers prone rapidly recognizing refentrytitle renderables resurrected
rooted runners settled ship shortly sliced slowly socketserver splitlines spuriously stating subtests suck thai thead
torn unaltered underlined unofficial unraisable unreliable variability videos west whoops xxxx acted alexander answers
attaches awaiting bell bevenius blocksize capitalize ccompiler certifi chardet clip clutter confidence converters crop
dealt deduping delegation demanded deprecating dereference discards discourage discuss dubious dunder emails emitter
everybody exceeding exercising explorer factorial fifo filemode gentoo greet hatch heimes helped holes hukkinen
intelligently ipsum isdir jenkins juan keyset korean landing modname msbuild msgpack mtimes multilingual music
negotiate networking networks oblique overflowing pacote payloads permutation perry peterson phases picklability
planned preliminary proactor publishes pydebug questionable quinlan recomputed recurses referral regarded reinitialize
reinitialized remap ring roaming sadly scaling scripted sequencer shuffle staticmethods stepping subpart surprise
tagging taneli tidelift unclean unhoisted utilize worthwhile abstractions accessors acme adam aligns allocating
artifact balancing bizarre borrow bounding bucket builders chang cidr committee communicator conditionals conf
consulting conversely copyable delegating dependence displayhook distinguishing documenting downside drained east
echoing electron envelope eventual expiry factories flip fred generous geometric getmembers graphs guarded hartley
hmmm igor inadvertently individuals interleave interleaved intern intraline jeremy junctions knuth loewis meanings
messagebox modal modulename monotonic nagy navigate nine numerically nums optimizer orange outcomes overloads pain
participate peak pools prerequisites purge pyright randomness reassign relaxed responded retired reviewed rust scaled
sdists servername setitimer shadowing sharma shelley strs submits symlinking temple termios tester trickier undetected
unencoded uninstalling unlinking unquoting unrecoverable unreserved vast viable violated visits vohr whitebox xterm
yang yuck zipfiles abcde abuse accompanying accumulates activation aggressive alternately ambiguities approved
asserted awesome bastian baxter becker behaved biggest borins brotli browserify callout charsets cheng city clue
colorized commenting complaining compressing consulted contention crap decomposed decoration derivatives derives
doubling eligible endless enjoy entropy exhibit expense fcntl fedor feels fulfill funcs getcwd getdoc gist glyph
hardlinks ihrig inconvenient indutny interpolated invalidated itemgetter lying mangling measuring menubutton mimicking
minimally mounted multipath multiples munging mustn myles ndigits negatives netrc noisy notepad numerous onward
orderable pathological peephole phrases porcelain powershell progressively pulling pycparser radiobutton randomized
rearranging reentrancy referencable reimplementation reinserted rejecting reschedule ryan sandbox september seriously
shareable shrinking signifies simon squeezing stanza subshell synthesize sysctl systematic tabnanny technology tedious
testlist tightly timezones tokenization tokensource tolerance transforming translators unclosed unicorn uninstallation
unprocessed untabify uploads accumulating atomically backtick basestring basket bryan bubbles bumps cacache cadata
cafile carbon chunksize committish conceivable connectivity convince cores czech datatypes deduplication degenerate
deliberate delim deployed dereferenced desc disappears dispatcher distributing doubt draining drivers elliptic
emission emptied ensured evenly exploit exprlist finalizers finalizing fires fooled formally frameworks fromlist glue
gmtime gnome griggs hackery hazel herein improper insensitively intensive international interpretations introspect
jupyter latex launches layouts lazr libtool listcomps makeinfo matplotlib meanwhile mingw muck nanoseconds nowhere
oauth onboarding orig paying phil placement presenting producer prototypes provisional purported purposefully pyvenv
quitting quotient rearrange recalculate recompiled regress reis representative reveals rework risks roberts ronald
routed safari santiago schulhof settle signalling simplejson sitecustomize sortable staleness subkeys subpackage
subsequence sums swallows synch talks targeted thoughts toss translatable uncollectable united unread varname vladimir
walker wall wget zips abfnrtv akin amongst ancestry argc authoritative beforehand believes bigint boring breakages
bytecodes caps cautious cease clamp clarification classified cmdclass collation complained currentframe currentmodule
danger decisions deflated delays deploying determination disclosure discovering distclean dmitry encoders exponents
extensively filip filterwarnings fixers flavours forming gimeno goals guesses harm hashed honour hring hunks
hypothetical illustrated inferring infos injecting instr intrinsic isclass jeremiah keepalive kick king knew lchmod
leopard libintl lstrip masked messaging miller misses mississippi mistaken msvs munged ndash nursery offered paid
partials pauses penalty percents percolator populating presses prop proved pygmentize pyre pythonic redraw
refsynopsisdiv rerere reverting revoked rigo rowspan scalars scrollbars secrets selectable semantically sequentially
setxattr sharp shortlog singular slack sometime sqlite squash stacks sticking supplement suppression tempting
throughput tooltip traits transactions unloaded unmapped unprintable unsetenv unterminated upfront uploading utterly
vanished virtue watched watches weighted winerror xmlrpclib yeah agents agrees archived articles artificially
asserting audience avoidance babel backpressure balance bedford beth billion bitbucket bluebird braced bridgewater
bringing bruce ceiling characteristics churn coalescing codepage codepoints companies conformance customer danjou
deallocating decryption denials difficulty disassemble disassembly disaster distributors disturb doubly draws
duplicating elegant emulator encourages england exotic expandtab facilitates facing filetype findall gateway getset
gradually guilherme harlow identities immortal inexact initiatives inodes insn intermixed invalidation itemsize
iterative judgment ldquo learns linesep linkable logfile longname mailinfo mailmap marchini migration mkstemp modelled
mullender multicast multiplied myself naked namelist neat noticeable nowadays owning pandas parsable participation
passive plugged pollution prepublish presently presume promisify pulls punt qsize rank rdquo redundancy reminder
replies repodata rmtree ruben safest scipy sidebar sink sjoerd sloppy sneak snow splice squeezed squelch
stringification subscribed suspicious synonyms tickets tracers triagers typer unencodable universally unmaintained
unmerged unpickle vanilla varying vcvarsall video wang wcwidth whereby whoever acting administrative ancillary andy
archiving arranged autodetect automate backports backtrace balanced belanger believed borrowing brew brings canary
cascading caseless challenges chat chen choke chop coercing committer companion competing comprises constitute
conversation covariant cryptographically cvsserver damaged debuggers decrementing deserialized deviations disc docfix
editwin envvars epilog equivalently european experiments fiddled forkserver freebsd freelist functionally gztar
incompatibility indeterminate infers infinitely infix instantly intelligent interspersed iojs isdatadescriptor keysets
kinda levelname liberal libpython localns lorem love magenta makefiles manipulations metacharacter mildly mktemp mocha
msgids musl mutations napi narrower ndiff neutral nfoo nicholas notifies numeral overlaps overrode parallelism patrick
persists picks pids pixmap popitem positionals probe proceeding proven provokes putrequest quirks quota rafael
reasoning receipt rectangle refspec regeneration regexps repos reraised rescan reversible roundrobin scales scoping
searchable sebastian senkpiel shifts shipping sigma simulating spanish spanning speeding spin spots strategic
subresource subroutines suffixed suitably tabbed tdqs testfile thereto tokenstring trashcan truecolor turner tutorials
unaligned unblocked underflows unpublished unsets unsubscribe untested urlsplit vendors vertices viewable viewed wasm
wasted weakrefable williams winner zipped zombies accounting adjusts adrian aifc aimed albeit analyzing andrey anyio
autodetection autosave autotest bear bidi bidirectional blacklist blessing bright bubble buildout cards casts cater
chalk changeset charles cjihrig clamped claudio codemod coefficient complies compromised concise confuses constitutes
contextmanager coverity cvsimport decreases deduplicated deletions delimiting deployments detailing dispose
distinctions distlib distributor divider durations eliminated elimination emeritus endlessly enormous entrypoints
evidence examines expiring extern faulty feasible fell firewall flakiness flows forrest forum fragmentation frontends
gaps getsource gireesh globalns governance grabs hackish hacky hadn henry hierarchies hole hoping hunting identifiable
ifdef imminent inadequate incur instructs interpolate interruptible iteratively jacob keith kenneth lacked larry
layers lchown lexing linearly linenostart linenostep luck mathewson maxlinelen mbox median migrating mimetype netmask
ngettext noarch observable optionals orgs overriden paned patchlevel pertinent pkgs planning pooled postcommand postel
precompute precomputed premajor privileged probable proprietary punathil punch pycon raster recompilation redis
refname reimplemented reiss reliability relink repetitive reviewing reword rollup seeding shalom shield showwarning
sourced stoll stylesheets suboptimal subs subtracting successes suggesting sysconf thereafter thru ticks timeframe
tony trapped treeview tstate tuned tzname unbalanced unblocks unencrypted unsuitable vcbuild waiters wasting watching
widest winreg wonder xref yesterday zzdummy abcdefgh abusing accompanied accomplish ackermann aclose activities adams
adorno advisable alterations appauthor argspec arrived asymmetric autoindent barney bartosz bendersky board bomb
borders bracketed california cancellable carries catastrophic cfile charmap classification closefd cmake codecontext
colorize colours commons compileall configparser consoles constantly constructions contest convey correcting danielle
datefmt datetimes denoting deserialization dimensional disappeared dumping eastern emeriti enclose enforcing epoll
estimated etype eugene eviction execv exempt expanduser experiment explode filehandle framing genexps getmodule
getpwuid getusersitepackages gname grained grayscale gruenbaum hamel hammond heapq heights homebrew hughes illustrate
inevitable informs initializers injects insensitivity instructed integrating intelligence intermittent investigation
iron islink ivan johannes kleineidam lambdef lars legally locates loomis mcontext mercurial microtask mktime
moderately modernize mojibake monotonically motion myfile ndef night nonnegative nonsensical objective offering
ongoing opinionated oracle outright overloading parseaddr persisted playing pnpm postmortem postpone preferably price
primordials principal profiled promoted provoking pump pyclbr pyversion radiobuttons reachability reals rebecca
recalculating recipes recommendations recompiling recovered refael refcounts refine rejections remotes repeatable
roles rolling saturday screw searchengine sendmsg sensibly setsockopt settable setuid shame shifting simplifications
skokan slip smtp snapshots sosnowski spaced speak spinbox splitter squeeze ssri stealing steering stretch
strikethrough subnet subpatterns subsequences subsumed subthread successively suffice summarized supposedly surely
swapping tabular tars thousand tightened touches trademark traps trevor ulimit unassigned uniforum unlinks
unnormalized unorderable unresolved vendoring verifier virtually whichdb writev wrongly aaron accelerate accelerators
addinfourl alexey aligning analyse argon assess authorship avail bandwidth basenames bench bisection boom brandl
broadly browsing cacheable caplan ccache cdef clauss collabora combo communicating compilations complication composing
condensed confirmed confirming confirms continually controllable convoluted creationflags ctor ctype cumulatively
decompresses delimit deltas demonstrated dictorsetmaker disconnects drag drift enumerates expressing factoring facundo
fahnestock farias flaws flock fool foreach france fuzz gathering gcontext geng geoffrey giampaolo gibson happily
hellip holders hotfix humans implying inaccurate informed inlining interning invariants isgeneratorfunction japan
jiawen kicks knob kyle lance lexically likes llhttp localeconv lowered lzma mangle marshalling mathematically maxsplit
memberships mikeal minimatch misconfiguration mohammed moshe mozhet msgmerge multiplexer national noinspection
nonblocking nope notifying ohtsu oparg packument panes participants pathspecs permissible pgen pickler polyfill preid
preminor prepatch preprocessing pretends preversion privacy promotion publishable punting qualifiers quicker quits
quopri rationals readahead reaped recalculated refill reformatted reimport relates reordering responsibilities
restoration retval reveal rodola ronacher rotated sakthipriyan sampled sandboxing seemed seemingly selective sendto
sentences serially setblocking setsid seven shasum shigeki sliding stacktrace staging startupinfo statistical stewart
stomping stty subkey subscripting subsubsection subsystems tabify tabstop tabulate tabwidth targetpath tbreak telnet
timothy triplet truststore ultimate undoes unices unixes unportable unsorted unstar untokenize untrack unwise
unwrapping upward vague vairamani valuable verbs walked warranties webbrowser wilson winds winsock withdrawn
abbreviating achieves acknowledge addison adequately alloc alphabetized amet appveyor arboleda assets asynchat
automagically azure backreference beautiful beneath bitmask blerg bonus bracketing bsddb buckets cascade cctest cdecl
chengzhong chose circumvent cmdline codecov coghlan compresses consensus continuously contrived conv conventional
cooked copytree cropping deadlocking debundled decorating decreased defacto defeats dictate digging dinsdale
dirsymlink disallowing disp disposed dissect dock dolor drains drake drawings duping dying echoes empties enforcement
engineering enqueued entitled enumerating establishes evict exhausts expandtabs exploits faced faithfully falsey
fiddling fillvalue firstlineno flood foord formatargvalues fromfd functionalities genericpath georg getargvalues
getclasstree getcomments getfile getinfo getsockopt getsourcefile glossary grace halter hangul hesitate htons httpx
hundred hybrid hypertext iconv indentwidth initialisation initiative insertions insurance interchange isbuiltin iscode
isdst isframe isfunction isgenerator ismethod ismodule isroutine istraceback ivar javadoc johnson killer libedit
linters longlink luke memoryviews misidentified mkpath motif mountpoint mousewheel movie munge nbar negations nightly
nominal nulls occupies opinions outwin overrun overzealous pairwise palette peculiarities peeking pformat picky plays
plenty positioning postversion precomputing privilege progressbar progresses pybuilddir pydistutils pyopenssl quantify
quantities rebasing recognition reconnect reconstructing redact reinstalling relay resolvelib reversion revocation
ridiculously rlcompleter rose roskind scandir screens scrolls shiftwidth siblings signum slide slows slurp smtpd
smuggling sneaky somefile sparc splituser sporadic stacked stem stereo stevens story strbuf subjects sublists
subparsers summing survives swaps swedish tabbing tagname tearoff templating testfunc textconv threat tidy tooltips
trivially tsqs tune tweaking ujjwal ulps undeclared unformatted unsaved unwritable upwards urandom urlretrieve
utcoffset uvwasi varnames vfpdef vietnamese vincent waking warrant watson william wsgi xinclude abstracts accelerated
acknowledgements acorn advances alarms alexis alike amazon anticipate apostrophe apples argtypes arrangement asdf
assembled assist asterisk averages awaits awakened battle booth brevity broad bulgarian buus bytestrings cachecontrol
calvin campailla canceling catalina changelogs clickable codepoint colormode cols commonjs computers connector
consolidated constrain corrections correlate cosmetic counterintuitive criterion curves darshan dbus death dedented
ditch diverged door dower dutch earliest elevated emulators encapsulate enhancement entirety enumerations errata etag
euro exploring exporter farms federal fontsize freezes fundamentally funky generalizations genuine gertzfield
getcallargs getrandbits gimmick gitignore gold goodies gross grouper hardening headaches hindi httpcore idna imap
immutability impedance indexable induction infile inhibited initializations itervalues jeffrey jones kwonlydefaults
lame lastly legendecas libfoo licence listcomp lnotab localname logarithm loglevel lvalues marco marginally
materialized mathematics maximizing mdash menuinst middleware milad mips misbehave miscounted mixins mkdirp mobile
monkeypatched monkeypatching moss movements msecs ncurses negotiated nicolas nightmare norris norvell notations
notions npmlog numlines obtains ovector packagename packer pairing paolo parenmatch pathbrowser pavel phillip pinning
pipelines plausible polar postprocessing posts poststart preexisting preparer prepends prestart professional prohibits
promised pseudorandom pyexpat quad quantifiers rajlich randomize readlink rebased rebuilding reconfiguration recvfrom
redisplay refreshes regions reimplement reindent relativize relocated remind removals repaired reporthook restype
rethrow rimraf robustness routing rpath rset runeval rushing sail scott screenshot seamlessly searchexclude searchopts
season sectioned seeded selectmode sentinels sheikh siginterrupt slider smallexample smtplib socktype sounds squares
squashed stackviewer staff steel strengthen stringent subiterator subpattern subscripted successors sucks summer
superseded synthetic tacks tenth ternary theoretical threadpool tighten timetuple todd toolsets trademarks transfers
trickery tuesday tzset uncatchable unixfrom unreasonable unsure unwind utilizes voice weed welcomes wfile wouters
accordance acronym admins afraid agnostic alphanums approval arriving attackers auditing authenticates authorities
autospec awful bacon beaten berkeley beside bluetooth borland callees callouts casual ccontext claimed classify cloud
coercions colno comfortable concatenates configurator contextvars cookielib coord coordinating copyreg coredump
covering crossings crucial daijiro dcgettext debuggee decreasing deduped definitive delaying denominators deregister
derivation dfile dgettext dirk diverges dividing dodgy dont eases edward einat evolves exactness existent experienced
exploration fakehostname fdopen felix fielding fieldname filed filesize firing firstly flipped flowing freedom ftplib
fudge futimens gains games gengjiawen gently getpass getresponse gilli gonzaga granular grew gruber grunt guys halfway
handshakes hardly harmonic hassle hdrcharset hexdigest hexdigits hoops horribly htests hundreds hyperlinks ijaz
impacts inaccessible incorporating ineffective inferior inhibit insertofftime insogna inspects interruption intimate
invent iomenu irrespective itanium itorg jonas jumping keystrokes kids lands legitimately linenumber linewise locators
lockstep loring lynx mailboxes mainmenu maintype mandates mantissa markus marshaling mary maximized meaningless
mediatype meeting messes minidom mises mnemonic modeline momentarily motivation msec multisets multithreading
mysteriously myvar nbaz negatively nikolai nline north nose nprint nullptr observe octopus opname orphaned outsider
overallocation permitting plists polo possibles prec prepack preprocessed prettify procedures promisified proportional
quantum quotetabs recast reconstituted recurring redundantly reentrantly reinstalled reitz relations renegotiation
reprlib reqs rerunning resembles resorting responding rewrote rogers rollover runscript sandboxed scattered seeked
setpos simplification singledispatch snap south splitdrive squeezer squelched statuses subitem subscripts summarizes
survey susceptible tear techniques temptation thoroughly threw tian tracer traitlets triangular trickle triplets
tschalar unconstrained underlining underway undici unichr unintentionally uniq unpackings unpickleable unpinned
usefulness uselessly utime utimensat uuencode venvs versioned volumes vwait wakeups warrants whatsoever york
abstractmethods acknowledged adaptation admittedly affordances alas anatoli angles annotating announce arena
arrangements asctime asdict backgrounds backtracks baseclass benchmarking bing binutils blacklisted blksize blowing
blurb borderwidth borrower branching breakdown bullet cancellations cbreak cclauss certdata ceval chan cheaper chopped
claiming clarifications clipping coarse codename combobox conclude condense consequent contravariant copystat
countdown craig cyren daemonic dataurl ddir dealloc defensive degree delattr deng denies deref devanagari dialogues
dickinson differentiation dingus disagreement discriminator disposition disrupt dozens effectiveness embedders
enterprises enthusiastically establishing evans excepthook experimentation exprs extant extraglobs father ffff figured
fileinput fingerprints florian foobarbaz forgiving formulas fortran framed fsencode fsmonitor fsync fwalk gallery
getnameinfo getrandom getuserbase gobble growing habit harband heapify helo hexlify hinting histogram hotkeys httpd
hunger idempotency idiomatic impression imran incl inconsistently inquire insertborderwidth insertwidth interference
ioctl ippolito islice jackson jain janssen jeepney judge junction junon keyfunc keysym klass kunal kurt lambert landed
libasan libxml lifetimes lisp living longstanding loosen lovers macbook mailfrom marc matheus memoization memoizing
micro minified mirrored misbehaving mnemonics monospaced multidimensional multiplicative multiprocess multiset myapp
mymodule namespaced nonstandard nonterminal nontrivial noproxy obstacles occasion openhook opera optimisation
optionflags ouch outencoding pathak pluggy poking portuguese preferring preloaded preloading preservation prince
printout projection promisor promptly proposals props provenance provision pthread puzzle ratios rcpttos realname
reassigning recognise recoverable recreation recursed recwarn refined refinements reinitialization releasers relevance
remark reopened repackaged repeatability replaceable resurrection rigorous scaffolding scary scrypt securely seealso
serbian shapes similarity simplistic singh skew slackware smarts sought specials speedups splitext splittag stabilize
stdcall stdev stretched stroke subpkg substantially subtracts suffers suffices surprised surprisingly sustainable
synchronized synchronizing syscalls tacked testdata testmod thefourtheye tierney titlecased tongue transit
transitional transpose turtles typings unanchored uncommitted undecoded undeprecated underscored unixy unlocks
unnumbered unpaired unparse unpickler unprivileged unsatisfiable urlchar ustar vcruntime verigakis vogt wachi whee
wise wolfgang workloads young zoomed achieving acquisition addressof adheres adopt aforementioned agen aggregates ahem
allowance alright alternation antivirus arenas asian assurances augassign augments authinfo authorize autodetected
badges balls begun bethard bibliography bigmem bitmaps blech bnoordhuis boss bplist bumping bztar calendrical cavity
chapman cheat chief chore clark cleartext collide completers complying composition comps conclusion confidential
connor consectetur considerable constrains cooperation corners corrects costs countries cpplint cron crypt cvar cyan
dataset datastructures deactivated debuggability decrypted deduced deepest defn delicate demonstrating desire
determinism devsnek differencing dirnames dirpath disambiguation disney dlls docclass dotenv doublequote dramatically
drawable dropdown dublin dull dumbdbm elit embeds emphasize employee employer entrance errnos erroring excel
exponentially exportselection extractions fchown feedparser fence fibonacci finer fodder fprintf friday fromtimestamp
fromutc frustrating gate generalize getoutput getpeercert getpeername getrlimit gettotalrefcount glitches globbed
gordon graham granger gregorian haystack heard heck historic hurts iarna ideographic imitate imposes incidental incurs
inorder instant instrumentation interoperable introspecting invalidating invalidcommand iscoroutinefunction joinpath
konqueror kumar labelanchor labelframe labelwidget ladha largefile largs launchers ldflags lengthy leveraging
lexername libnode licensee limiter linearization linkname lognormal logos longlist lord lyrics mandate marshall
marshalled masashi masking maxpath medeiros meertens metainfo meter mixture modeling msgcat msgunfmt myscript needn
nifty nonlocals notebooks odds offvalue olson onvalue opportunities opting orient ostroukhov outmost ouyang overwhelm
palm panedwindow papirovski parameterize passthrough peel peoples percolate pexpect pins pleasant polls pooja postpack
postrestart poststop pread precomputation preproc prerestart pressure prestop primes prominent promotes promoting
proving putter pyparse qsort quantifier racy radio randel readrc realloc recursivity referent referer relief
removeduppaths reproduced republish reserves resolvers resumption ronn rotating roundtripping rpar rpartition runctx
sash sashes scores shard shrinks shuffled sieve sizehint specializations sprintf staged stamps startline statespec
streamline strike study subelements subitems summarization surface swallowing synched syslog tails takefocus terribly
textvariable thakis thou thresholds tighter timeline timespec titled tokeneater tolerances toml topologically trade
trange trans trips typename unadorned unarchiving undetermined unpacks unpatched unstarring untagged unzipped updater
urlencode userland validatecommand varied vavilov vcxproj violations volatile watchdog worktrees wraplength xargs
xpath xscrollcommand yadong younger yscrollcommand abnormal aboard abstracted accent accented activatable activates
adipiscing aggregating analyzer announcement apologies apparel appdata archivepath argue arose astuple asyncgen
attachments attrib backreferences baked bang batched batista behaving bells blinking blocker boltons borrows broader
bytearrays cake canonicalizes canst carlo ceil censure cffi challenging clobbers cody coincidence colgroup
colorchooser colorscheme comrade concerning constructable cordasco coverdir creations cryptic cube cubic cute darkbg
deepcopyable deflake delivers demands dependabot designate destructive diagonal differentiates diffstat director
disagree disastrous distant distclass divergence doseq dulls elicit emax emin emojis empirically encapsulation
encloses endorsed enqueue entertainment erick errorlevel escapeinside estrada evolve excuse executors exploited
expovariate extractor faking farewell faults fileobject findfiles findings flash flawed flexibly fooing franziska
freenode friendlier fromfile fulfilling gang gaudy gender getgroups gethostname getint getservbyname getwindowsversion
grapple guts halt hammer harden hashables hast hastings havoc heblikar hinkelmann hirano homogeneous honours hooked
hopes house humbly husbandry hypothesis ibarra ifelse ifndef imaplib incidentally incredibly instrument intercepted
intrinsics invites iomark ipaddr iqbal irrational isclosed isolates italics iterability iterparse johnny johnsen joint
katz keyid keylog khaidi kicked knownfiles krems laertes lauder lender leverage libcurl libnpmaccess lieu lightbg
liking linkers loan lookaround louie lpar macdef madsen magical magna majer mapper margins mateusz maxdata maxlines
meddles mersenne messageboxes metcalf meurer migrated mine minimizing mirroring misspelled mknod monorepo msginit
msgstr multicasting mypkg mysterious narrowing netmasks nickname nits noon nullcontext occasions office oleg ophelia
ordinals organize originates outsiders overread ownself pads para paranoid patt pegen permits piers pike plistlib
plugging poison polish polite polled pout powerset pragmas precepts predefine proclaims profilee progressive propose
publisher purse pycacert pyflakes pythonrun quarrel quietly racing radians rapid reacquire readall readiness reapplies
reconfigure recreates rectangular redacted redefinition redistributors reflecting refrain refreshing regenerating
reinsert relate relational reliance reloads repacking revisited rolls roseman ruler saimadhav saml saner sarge
saturation scraping scrub sean secondly selfdot serhiy servants settimeout shear shoulder showrefcount slowdown smiles
snapshotted song soul southern specialization splat srivastava startswith station statusbar stochastic stomp stopline
storchaka straightforwardly strangely strikes stringescape subhelper subnode subparser subslices substitutes subtyping
symbolically symptom synced tarinfo tempname tempor terry textdomain thee thine thumb ticking titlebar tommy tons
tornado tradeoff trait traverses triage trial tricked tripped tripping trunc turds tvars twister typechecker typedefs
typeset unblocking undef unfledged universe unladen unloadable unpipe unproportioned unrolled unsubscripted
unwrappable urlencoded userbase userdiff vaguely variances varkw vcproj vital volunteers vulgar wadllib wanting ward
warmup wasteful water wday webpack weijia weirdly wendel whistles workingset worried xcrun xdiff yday ymdhms yours
yrange zaki zhao zrange zstandard aahz abbrev abis absorb addch administration advertisement advise alba alice aliqua
alleviate amending analogy antonio apop approve argcomplete asset associates astral asymmetry atan atlow attributable
authored automake automates awoken backslashed baddie barfs beauty bias bigmemtest bindtextdomain blockquotes blorpie
books boron btoa buck buster byref cacert canonically capitalization capitals casted categorized charged cheryl cite
clashes classifies classnames clusters cmath cmdloop cmds codeset coexist coincides collate comfort compilable
consolidating constituent coords coveralls crosses cumbersome curdir cutoff cuts daemons debundling decomposition
decouple delims denys dequeue detains deviates dialects dialogue disambiguating discriminating discussing disks
dismiss distinfo dnlup dolore dramatic dtoa dylan dylib eats eighth eiusmod enumerated eprice escapechar eventloop
excessively exclusions excruciating executive expatreader extensionless extremes eyes faces failfast faithful famous
feat featured filehandles film fisher flashing flight flipping focusing footnotes frank freedesktop freevars fstring
fullmatch futimes generically gestalt getcompname getcomptype getframerate getmark getmarkers getnchannels getnframes
getparams getsampwidth graft guid harnesses heuristically highlightthickness hitesh hosting hostmask hungarian hurry
hydrogen hyphenated iacute impacted inactivity incididunt incompletely indiscriminately indistinguishable inelegant
influenced influences initargs initiates initscr interchangeable interpolations interpretive intranet intrusive
inttypes irish isoformat itamar jannis jeong justin kelvin keycode keyvanzadeh knock kuchling kwonly labore laid legit
libz limbo listings livia loud lutimes magically maildir maintenant maketrans mandated manifestation mappingproxy
maxlevels measurements mendez mick midpoint minimized minsize misinterpreted moments monokai moral morefield morozov
msgctxt mutexes myhost narg nearby nielsen nizipli nondeterministic nonetheless normalising northern norwegian
notwithstanding ntilde nullish oacute objc ocirc ofrobots opendir openers optionmenu orderings otpcode outputted
overruns pacific packrat patent pathing patreon perror phony pinard plans player pobox political polluting ponyfill
popups posixmodule possessive pouf powered precursor prefixlen preparatory preston printables privately processstdout
promzard prudent pstats randall readframes readily realistic reboot recognizable recvmsg redefines reedy refspecs
registrations relpath remarks repopulate reproducibility rests revisit reworded rfile risking road robinson roundtrips
rudimentary rvalue sabella samuel saturate saxutils scenes scrubbing searchlimit searchstaleness serv serverlisten
serwy setcomptype setcontext setframerate seth setnchannels setnframes setparams setsampwidth setupterm shifted shiny
shrunk signaled silverwind sint skipkeys sliceop snprintf solicit sourceless spectrum splittype srange startpos
starttls steen steppable steward stretches strides stringifying stuffed supernet supplemental surrogatepass survived
suspected tailor taniquetil tcsh tenacity tfpdef theorem thunk tjhsst toctree tokenizing tomli totals trials
tunnelling typedargslist unchecked undergo uneven unilaterally unreadline unreleased unresponsive unsatisfied
unseekable untitled upset useable utilization utimes varargslist vertex victor visualize visually vous vswhere wastes
wbits webster weekly weibull wesley whatis whilst windowed wired wishing woefully wont worm worrying writeframes
writeframesraw xavier xcodebuild xmlreader yagiz yank yash yorkie yosuke zeroing zkat zstd academic accessibility
adnan adobe affords agency aggregation alan albert alef aleksey amenable analytics ancdata anchoring anders anderson
andre annassign answered anton appreciate arange arborist archspec argcount arity arrival ascher assemblies authoring
autoindented awkwardly axis babylon bamboo barbazquux barebones barfing bayard belder bert betavariate bitter
blanchard bower boxed breadth brighter burden burn burnett calc carlos causal centrum chart chksum ciphertext clarke
classroom cluttering cobalt codeop coherent collaboration commutative comparator conceivably confident confstr
containment contrasting cookbook cookiejar copyfile correspondence coupled crate cruddy cure cypher daeyeon dahlin
dalton danny davis deadbeef deadlocked deallocate debuglog decipher decompressing defensively deno denoted destructors
devoted difficulties digestmod disassembled disassembling discernible disclose disconnection discriminated dished
divisor dngettext domainname dotproduct downgraded dragged drastic drepper dubnium dyld eacute eclipse edmond egyptian
eliciting elseif embody employed entails envvar eppstein erbium erich errant errorcode escalation evaluations exhibits
extractall eyeballs fallthrough fantastic favorites favors feeling fermium findfile firstline flowed fontxxx fopen
forbids foster frederiksen frotz fruity fullwidth gathers gaussian generations genexpr getboolean getchar
getdefaultlocale gethostbyname getsignal gettarinfo gitattributes gitdir goofy graminit grand grange groupby guided
guile gunzip habits hans hasher headache headersonly heads hear helt highlightbackground highlightcolor hijacking
histories honestly hooray hopper horror idleib idlever ifconfig immune imperfect implication inadvertent
inappropriately inclusions increasingly indicative inited inputhook instrumented inter interdependent interfacing
intersect intersects intrapackage irreversible isfile ismethoddescriptor isocalendar istanbul italian iterdump
itermonthdates jesse jitter joyent karma kennedy kent kibibytes kippes kohei langa leakage lean leko liblzma linaro
linkpath listened listmaker locality logb lrange mailcap mailhost matchers materialize mathematisch maxsockets megs
menudefs mission misspelt mmarchini moderation modernized mohd monkeypatches monthly msgattrib myfunc nameless
nathaniel navigating ndarray ndbm neatly negligible newversion nison nitzan norm nosigint noting nulla nullable
onclick openbsd optdict orgname orientation otrishko overfill overlay overwrote owing packagers paneconfigure pango
papers parenthesize parrot partialmethod pathsep pathways pechkurov percentile perforce periodic perms philosophy
pkglock pong poplib positionally postbuild postbuilds postscript prebuilt precisionbigmemtest preclude predict
preimage primality println prize probes propensity prototyping provisionally pummel purposely qname quantile quantiles
quartiles quic quis raphael ration reclaim recode reconcile reconnecting recycle redefining regressed reimplementing
reinserting relays relicense relinquishes remediation removable reordered reparsed repeatfunc replicated reside
resizes restructuring resumable retention revalidation reworked rewrapped richcompare ricky rizvi robots rodriguez
router rovito rowe rpipe rstripped saihadhav sanad sanitization saxon scherer schonning science scottmg scrambled
scrubbed segfaulting serializers serverclosecallback setgid shelf shielding shields showwarnings signer signifying
skeleton slotted snake social sooner specifiable sped spending squared sslproto startoffset stichting storlines
streamlined strlen strtobool subelement subheading submessage subscriptlist subsecond subsections substack subtleties
subtly succeeding suddenly summed suspicion sweigart syllables tailored tamil tampering targetlist tchar tendency
testling testzip theanarkh therein throttle timedeltas toknum tokval tolist tone torture tossing trained transparency
transpilers triangle trimming trivikram troublesome tunneled tutt ukrainian ulrich umer unacceptable uncached
uncovered unflag unindent unroll untokenizer uppercased urgent utilizing uziely vdeturckheim vestigial veto visitors
walzer warm warranted watchers webserver websocket wedge wedged weekdays wipe woke wstr xztar yargs yongsheng zeroed
zinfo aaaa abbr abbreviate abramowitz acknowledges addendum addsitedir adotbelow african aiter algebra algos aliquip
allocators alternates amaury amuro analysing analyzed analyzes andres anim annoyed anto antonov antsmartian apis
aravinth archiver armed association associative assures asterisks astimezone astrand atid atob attribution audits
australian aute authorizes autoclass autocommit autonomous babyl backups barboza barfed barfile basho bazfile bcoe
beck beep begidx believing bicking binhex bite bitstream blind blkdev bloated blockwise blowfish bltinmodule boldface
bondage botframe bothering bottommost brainfuck brightness brutal bufio buildchain builddate builtinlist bulleted
bynens byou calendars calibration calltipes camel canvheight canvwidth carl carmichael casefold catchable ccaron cdata
ceases cellvars cent century chad childpid chrdev christoph cillum classdict classifier clipped cloneable clover clump
clumps codegen cohen colorful combinators commodo compileflags complaint complements compressible compressobj
concluding consequat conserve consts contacting controversial convinced corporate correlation covert credited creds
ctags culpa cupidatat cutting cyclical darken datastore dcngettext deallocators deciles deckers declines decompose
decompressobj decoupled decrypting deiconifying delegators depressed dereferencing derek deserializing deserunt
destructuring diagnosing diffie digression directing dirent disassembler disconsider discontent discrepancies
disregarding distances distracting divine documentations dominic donald drastically drivespec duis duque dzolonga
ecaron echoed ecircacute ecircdotbelow ecirchookabove educational electronic elide endidx enforces enim esky esmtp
esse estimation etree evicted excepteur exchanged exchanges execve exercitation exim explanations exporters
extensibility facto fakefile farm farnung fdst feeder fetcher filetuple fillcolor filtertuple findleaks flavour
foofile forgeot fpin fromstring frozendict fsdecode fsrc fugiat funk furthest furukawa fuzzing fuzzyman gaining
gallium garrulous gary gdbm geared gentle genuinely getfp getinnerframes getlines getouterframes getpreferredencoding
getservbyport getsets gettempdir gettempprefix gettextize getx giorgos gleaned glen glib glosses graduate grave
gravitational gregor grovels guest hairy handlerclass hardwired hashmap hashseed haskell headerlink heavyweight
hellman heredoc hijacks hiroto hitotsu hola holth honoring honouring housekeeping houston hrtime httpresponse hudson
hyper hyperparser ians idempotently iframe ihookabove ilen imitates implementers impls infamous infiles infolist
informations infs inoperative inquiries insides intellectual interacts intermediates introductory introspectable
inversion irure isabelle isaoh island ispkg itemtype iterdecode iterencode jakub jefe joiningfunc jose joseph josip
joyeecheung jscs jumped jung kanwathirtha keygen keynames kikuchi kludgy knight knowingly kong kurchatkin kwonlyargs
laboris laborum leidel lewis lexed libm libtextstyle lifespan lineends lingering linkify linuxes lion lita ljsdf lkkjj
lksdjjf localedir locker lockf lookbehinds looped loophole loosened lowers luca luckily lukasz lumholt macosc
mainthread majewski maji makarenko makelink maksim manuals marcin massage materializes matthias mattias maxdepth
maxheaderlen meat memb memorize menudef methname meyer microarchitecture millisec mimetools mini minifiers minim
minimise minimizes minuend minwoo mismash misterdjules mistyping mixes mollit morsel motivated msgexec msgfilter
msggrep msguniq mucked mult multicall multiframe multiplicities mutability mypackage naively namespacing namie nano
nanosecond narrowed ncycles neighbours nemluv newlocals newname nginx ngth niceties ninth nisi nlocals nntplib
nonamefile nostrud obtrusive occaecat odotbelow officia oliver onecmd optik orlenko otteneder ourself overhauled
packager packard pafii paradigm pariatur partialresults partitions pastes pays pchar peace pencolor perchance
permalink petka porqu posn precomputes preexec preliminaries prelude prep prescod presumes preul proactively prob
prober processstderr processstdin prof programmed proident pronouns prost puny pydocfodder pygettext pytree
questionnaire queuing qwerty radius ramchandra randomizes raves readv realfile realize reassigned rebuilds recency
recheck recomputation reconnection reconvert recovering redistributed referenceable registrars reified reinitializes
reintroduce reparent reporters reprehenderit requireid resemble resizemode restructure revamped revs richardlau rick
rint rocket routes rpchandler ruamel rudely runba runcode sage sakkis sanely scatter schindelin sebastiaan secured
sendemail sequencing setx sharded sharepoint sharper shasums shenanigans shippable shita shortening skeletal slaves
sleepers smooth sociable somerville sono sorezore sparsely specialize spewed spipe spotted sprinkled standardising
starring stewards stmts storchake straddles strcmp strengthens strfile structuring strung stubbornly stylize
subfolders subgenerator submatches submenu subtlety subtracted subtrahend sudden suffered sunder sunt superscript
supiido surround suru survival swallowed synchronisation syncing sysname taciturn tanh tarek targos taste tdqf teddy
telc templated temporaries tentative territory testability textbook thickness threadable tickles toks tortuous
totality tradeoffs trampoline transferable traversals trent tripwire troubleshoot tsqf twelve twist typedfile uchar
ueno ullamco unbinding unchangeable unclog uncolorized uncontrolled undesired undeterministic undiagnosed undisplay
unfiltered unguarded unhexlify uninformative uninitialised uninstallable uninteresting unintuitive unlocking unmanaged
unmark unmask unnatural unquotes unstructured unsuccessful unverified urljoin usec usenetrc usetabs utcnow uuencoded
uuencoders velit veniam versionbadg versioner viewers virus voidspace voluptate waaaaay warehouse weaknesses weeds
westley wininst winners wohlganger workload writedoc writestr wyatt xmlcharrefreplace xsltlocale xuguang xxxxxx yane
yihong yuta zane zipapp zlatkovic zoneinfo abide abiflags absolutize absorbed absurdly abuses acceleration accessories
accord acct accumulation adaptive adapts addaleax addfile addpackage addusersitepackages adhering adjustable
administrators advantageous advent adverse advisories aenter aexit aftr aggregated akhil alarming alexandre algebraic
algorithmic algorithmically allfiles allmethods alphanumerics alpine altzone american ampersand amusingly analogue
analogues analyser ancbuf ancbufsize andras annex annoy approx aqrln archivename arcs argrepr arms arnold assembler
attributed audited authuser autoattribute autocompete autoincrement autojunk awaken backdoor baddeley badger batches
bazel bbbb behnel belief benedikt benjamingr bigaddrspacetest bison bjorn blackhole blessed blew bloat blogs blurry
bodywrapper boundmethods bremner brett broadcasts brooks bubbled bubbling budeanu burmese burnette burr bzipped
calvinmetcalf canonicalization cargo caring carol casas catering certification chamberlain charlie charref checkin
checkset checkunset chooser chopping chrisdickinson christos chronologically clarifying classifiers cleverly closable
clues cmdqueue cmsghdr coalesce coccinelle codepages coincidental collapses colorization colorizers colormap colormaps
combinator comparands comparators completedefault computational concentration conduit cone conformant conscious
contaminate contex cooperative cork couch cribbed crlf crystal cthulhu cuni curio cvcontext cvsexportcommit dahlitz
danbev daniele dare dario darnell dart dcommit debated declarative decorative defaultvalue deficiencies defpath
defunct degrade deinit delightfully density denylist deokjin depict descended descr designing desk destructed devising
devs dictcomp dictproxy differed dirtype disambiguated disappearing disciplines disconnecting discovers discusses
displayof disposes disrupting distributes doable doctool documentwrapper dolly domenic donate doodah downwards dpkg
drawback drew dummyvar dundered eaten edgar edsadr effected elevate elts emphasized emptyline encrypts endchars
endpats endrec endtag entail envname envsubst eporting erfc errread errwrite esperanto estimates evaluable evanlucas
evidently evolved excepts exciting execl executemany execvpe expressly exslt externalized extractfile facade fairness
faith farazmand fcmp felt feng fetchmany fhinkel fieldnames fileencoding filler finan flask flattens flaw flying
fnmatchcase followup fontaine fooer foos forceful forceload forego formataddr formatargspec formulation francois franz
frombuf fromimport fromisoformat frystyk fstream fstringescape fsum futimesat game garbled gates gauge gavant gdams
geert generality germany getdefaulttimeout getentropy getfullargspec getnode getstatusoutput gettmarg getuid gibfahn
ginchereau gitter gmane gnumeric goahead googletest gotta grandparent guarding guids gulps gunk gustaebel gustavo gypd
hackiness hands harald heady heappops heinlein heirs hemisphere heroic hexlification hexnums hong hrothgar httpcon
httpsconn hung hunter hyperlink identd idling ignoreflags ilkka imitating importance importfile inconclusive
indefinite induce industries inflate infringe initiation initio instantiable instaweb intends intensity intenum
interchangeability interestingly interline interlocking interruptable intersperse intrinsically intrude invalidates
invasive invented inverts invite iomod ironpython irvine isort italo itimer jaime jamie janne jasnell jdalton joshgav
jsdom julia justified kamat kanji kappa keane kessler keyhan keying keylist keypad kfarnung killall kinderman kindly
kitty klauke kluyver knobs kocharin kowalski kronos labelled lambd lanscan lastupdate laying leafs legend lengthier
levelno leverages lexigraphical lgamma libname libssl licenced lifecycles lift lightness linden lindstaedt linenum
lineterminator linuxthreads lithuanian locs loggable lopez loudly lovely lseek macos mafintosh magnus makepath maker
manpy manufacturers manylinux markings marshaller marsonya matthewloring maverick maxcmsgs maxhop mbstowcs mcollina
meagain mechanics meetings megabytes memoise meng menubar mergers messed metavars methodname metric mhdawson midl
mindata minigzip minimist minqi misalign misrepresent misunderstandings mitigation modprobe monahan monetary monitors
moon morgan mortem msgcomm multilined mutator muted myers mypwd najera needle nests netstat newl nexample nframes
nigel nindentation nmessage noah nofollow nofree nolog nominated nops normalvariate nothingness notranslate nowaware
nowawareplus ntohl nullifies numcalls numerics numfds nutshell nynorsk objections obligations obscuring observers
obsoleted oddities onlinehelp openpty opinfo optimistic optimizers optimizes organizer osenv outbound outputfile
overdue overflowed overline overlook overrule overspecified oyyd padx pady painful pants parallels parental pareto
parsimony participating partitioned patchings patrik pausing pears peculiar peekable performances pertains pervasive
phew pitfalls plot pluck plutil ponies postcompress postmyscript postponed postpublish practically pranshu
preallocated preceeding precompile precompress preformatted premise premyscript prepstr presets pretending prettier
princejwesley principally principles prioritization projectname proportion prospective prot province pseudofiles
publishers putenv putters pyio pyrex qingyu qnames quotechar rackspace raffle railroad rainbow rand randint ranlib
rargs rates rawmode rcpt reacquired reallocation reassembled reattach reattached reclaiming recomputing reconstructor
reconstructs recursionlimit redisplaying redundancies refetched reflexive refnames regresses reimported reiter rejoin
remainders remembering renderized reorganize reorganized repaint rephrase replacer replaying replication replied
reproducer rescanning reselection reselections resend resistant responsecode responsestring restructured retcode
retire reversal reversing reviews revokes rewinds rfstringescape rgba rinfo rlidwka rlimit roadmap rodrigues
ronkorving ross rowcount rubble runsource runtest ryzokuken sanders sanitized santa satisfiable scalable schroeder
scrambling scrape sealed sebdeckers secrecy segregated senders sendmail senseless sergey serializations setcomp
setfirstweekday setitem setvar sgmllib shaped shelve shopping shove shudder signedness simulation sinkkonen
skipinitialspace sleeper slowish smile sniff sockaddr socketmodule sockmap spams sparkles spawnv spdx speakers
sphinxsidebar sphinxsidebarwrapper spill spills spoken spottily spreadsheet spytz stagger stakeholders stan standing
stapleton starkwang starship starttag starttime stashes stata statefuncname stdname steady stoebich strength stubbed
stupidly subcall subdivided subexpression subnets subpaths subproc subscriber subscribers sunders surprises
surrogateescaped svidanya symref synopses szlig tarfiles teammates tellnes testdir testers testsetup testsource
testtar textdoc textually texture tfoot tfor tfrom theclass theirs themed thorny thorsten threadmodule threaten
timestring tmore tokendef tokenizes tokio tomas transactional transformers transliteration transpiled travel travels
triager trivikr trueconst trunk ttys tunnelled tunnicliffe turckheim typecheck typecode uctoffset udcff udpate umaks
unalias unauthenticated unbearably uncache uncaching uncancel uncancelled unclogs unconverted unescaping unexceptional
unfoldables unfolded uninstalls unintentional uninterruptible unloading unmap unpackers unpatch unregisters
unverifiability usenet userdata utcfromtimestamp utimbuf vakil vala vanish varietal vcan vera versatile
versionmodified vestige vformat victim virtualenvs viruses visuals vizworld vsemozhetbyt vuln wave webencodings
western whitelisted winning wisely witnessed wmain wolfe wonderful woohoo wound writedocs xstar yeardatescalendar
youruser yview zackery aaffaa abcs absolutify accelerating accelerations acknowledgments activebackground
activeborderwidth activeforeground activerelief adapting addressee addrinfo adler administered adrien aesthetic ages
aids ajkml akamai alejandro alerts alessandro alloca allocatable amend analogously anchorlinenos andrasq andrea
announced announcing anomalies ansicolor ansixxx answering anyplace apapirovski approximations ares arraymodule arry
ascertain ashworth askopenfile assembles atanh attrbutes austria authobject autocall autocommand automating autopoint
autoseparators autotools awaitables backgrounded bananas barman barrett bastards bbox bboxes bcrypt beginners begonia
beings benign biggerexample biggie bigincrement bignum bigsection bimodal bindtag bindtags bitbucketname bitbucketrepo
bitcount bitfield bitfields blab blaha blahb blazing bmeurer boards boolop bordermode borks bowels bpbynumber bpnumber
brad brag breach breaker breaklist breath brendan broyer bufflen bulletin buttonbackground buttoncursor buttondown
buttondownrelief buttonup buttonuprelief bytesescape callsite camelcase capwords cardinality carets carter catgets
cdefs cdict centerline centre cflag chainable chakracore charno chase checkpoints chiras chocolate choked chores
christmas chunker circulate classical classlink classlist classobj classobject closedfd closeenough cmdlist cmpop
cmpwrapper codebytere codeship codetags collaborative collective colormodel columnize columnspan commingled commitment
communicates compacted compendia complaints completenames complexes conciliant concludes condarc condigdialog condra
configurables confine consent conservation conserved consortium contacted contacts contradict conventionally cook
coombs coordination copysign correspondingly cory council cowlishaw cpuid cram crank cripps crossing cultivar cultural
culture currsize cword daily danielleadams danish darcy deactivates deallocator debounce debt decending decline
decomposes decorates decrypts deduce defragmented degas degraded deiconify denominated dependant deploy deselected
designator destroying destructively desugar desugars determinate deterministically dfas diagnoses diagonals dibs
dictiter diego diffing digitalinfinity dircmp directcolor dirfd dironly disabledbackground disabledforeground
disadvantage disadvantages discoverable discrepancy discretion dismissing disparate diverge dmabupt docdata docloc
docmodule docother docproperty docroutine dominated dominates doraise douglas dragto drawables dtor ducktyping
dunderscores dupes eating ecdh elementborderwidth elided elifantiev employ encodefunc encouraging encrypting endcases
endeavors endheaders endregion engineers ensurenl envs ephem epilogue equation erases ergonomic essence ethernet
eugeneo evens evidentially excclass excepthandler execing execle execlp execlpe execvp exhausting exif extglob
extradata fabulous farrell fdict featureless felipe fenced ffaaaa fictional fidelity fieldspec filedescriptor fileline
filelineno filelink filterer filterfunc fira firedfox fitting fixups flarna fleshed flooding fluff flushmode
followlinks fontmap fooman foot fooxxx foregoing forgetting formattername formattree formatvalue fragmenting francisco
frequencies freshness frexp frown fruit fulton gctest geremy getdocloc getfunc gethostbyaddr getlogin getsize gids
gigabytes gireeshpunathil gisle gitfile githubname githubrepo gitlabname gitlabrepo globstar glorious goodger govern
grade gradual grammatical grapheme gratuitous gravity greedily greyed gridded grip ground guybedford haha handlepad
handlesize hansen harshitha hart hashability hashbang hashtable hate headed headline heart helplist henstridge
heterogeneous hideous hightlights hiller hilo hilton hiragana hogs homecls ichunked iconic iconified ideographs idioms
idivmod imag implementor implmentation imprecise imyller incapable incident indetermined indicatoron indonesian
inencoding inexistent inflating ingvar inhabited inlines innit innocuous insertbackground insertontime insofar
insufficiently interactiveshell interferences interrelationships interrogates intuitively invasion invcmd inverses
involvement iobinding ipadx ipady ipykernel ireq irregular isabs isdata isfirstline ispackage isstdin italicized
italoacasas iterfind itokens janky jbergstroem jens jesus jewett jkrems joaocgreis joiner jpeg judged juice
julianduque kappas katakana kcookiejar kerberos keychain keyval kilobytes klem kludge korving kunkee kwnames lanczos
laurent lawrence lawyer ldexp liability liba libfoobar libiconv libmambapy libms libnpm libpath libreadline lined
lineend linehaul linkables linkedname listiterator listreverseiterator listvariable localename localtimes
longrightarrow lookarounds lookupmodule looser lorenz lowercasing lpinca lsprof lsum lucamaraschi magicfuncs magicvars
mainline maintainability makedirs makeelement makename maliciously mapfiles maraschi marcus marginal marginalia
markobject masahiko masazumi masinter maskdata maskfile masquerading mathmodule maxlinelength maxundo mdict meanempty
mechanical memchr memrchr mercy mere mergy meridian mexico microarchitectures miguel mild minimisation minitemsize
minused mishandle mixup mknodat moderated modpkglink modpkgs modulelink monsanto moore morsels mother mpmath msgcmp
msgconv msgen msilib multicolumn multiplexing multiplier mutables mybinary myicon myller mystery namelink namereplace
namever nasm nballs nbins nchannels negating neglected netherlands newlib newpos newsletter newton nextfile nextmodule
nextsection nexttag noble noncomparable nonexclusive nonnumeric nosuchfile nosuchoption notmuch numberlist numerals
numerators obeys objdump observer octdigits oddball olegas omissions opaqueresize opaquestring opargs operational
opportunistically optimised orangemocha originals orthography ostream otherbinary outbuf oval overhaul overrelief
pablo packuments pageanchor pageheight pagers pagewidth pagex pagey pagination palindrome panedwindows panels
paramflags parrotting partnership partway patters perm persian perverse phillipj photo pickletools picoseconds
pipepager pipesize piscisaureus pkgpath placates plainpager plant plumbed polished pollster porcelains postal postject
predetermined preformat premodified prescanning presized pretest prettyprinter prevstring primer processenv
programmable prohibition proliferation protos provisions provoked pseudocolor pseudoevents psmarshall punctuations
purcell purposeful pushback putheader pybsddb pydist pylab pymalloc qdtext queens quieter ralf rangeiterator rcompare
rdivmod reacquires readonlybackground readprofile reallink realpos reassemble rebindings reciprocal reclaimable
recordsize redaction redesigned redistributing redownload redrawn reducer refack refactors refcnt refloat reflogs
reformats reformatting reftest regional rego releaser relheight relocating relwidth relx reminding removedirs
renderers renegotiations renumbering reorganization repeatdelay repeatinterval replayed reposition repositioning
reprocessing republic repurposes rescheduled resembling resident residing resilience resumptions resurrects reuses
reverses reynolds rickyes riley romanian ronaldoussoren roole rootx rooty roulette routinely rspangler rsplit
rstripping runfunc russell rvagg safeimport salutation samefile samuele sandboxes santigimeno sashcursor sashpad
sashrelief sashwidth scaleb schwartz scraper scrollregion sdev seals seldom selectbackground selectborderwidth
selectcolor selectforeground selectimage sensitiveness sequent serverthread sess setgrid setiterator setrecursionlimit
settrace setups shachnev shadows shaky shallowly shapesize shards shaun shaw shebangs shielded shisama shortcomings
showerror showhandle showtip showtopic showvalue sideband sigchld sigmask sigpending sigtimedwait sigwait silicon
simdutf sixteen skipdocs skog sliderlength sliderrelief smallerexample smallish socketless sortwrapper sourcefile
spawnl spawnle spawnlp spawnlpe spawnve spawnvp spawnvpe specialist specializing spelt spilldata spilldescriptors
spilt spinbutton splitattr splitdoc splithost splitpasswd splitport splitquery splitvalue sponsors spoofing sraf stab
stalled stallman stanley starimport starimports starvation staticcolor staticgray statistic stefanmb stepanyan
stepwise stipulated stojanovic stopframe stoplineno stoppable stopwatch strchr stri stripall stripid stripnl studied
stufft styleguide subcalls subcmd subexpressions subfunctions sublanguage sublexers submissions subobjects subprogram
subranges subst substr subtext succession summation superscripts supervisor supplementary supplementing symmetrically
synonymous synop synthesized sysadmin systematically tacking tagger takewhile tally tbar tcpconnect tcplisten
tearoffcommand tempcache tempfilename tempfilepager temptative tentatively terminfo terse testdumbdbm testrepr texp
tfalse thenable thiago thisclass thor tickinterval tickle tier timeunit tkerror tmant tokenizations toolbar toolbars
topdown topless tougher tour trail transpiler transported troubles trough troughcolor truediv ttypager tunniclm twine
twofold tyler typechecking typographic typography ufds unacquired unaryop uncollectables uncollected uncompiled
underhanded unfinalised unimportant unitialized univariate unixccompiler unknowable unmarshal unmarshalled
unmarshaller unparsable unpicklable unreferenced unrolling unserializable unverifiable unwindng utctimetuple
vanishingly vararg variabcles variates vastly vcmd venture verdaccio vetted vexing ville visiblename visibly
vkurchatkin vonmisesvariate vote voting vvvvvvvvvvvvvvvvvvvv wayne wcswidth weakcallableproxy weaken weakproxy wherein
whitelisting whitlock whitlockjc widthxheight wikis wincon windres wireshark withdraw wondering wordchars workalike
workshop worms worries wreak wstokentype xrefs xscrollincrement xsltexports xsltutils yoshikawa yourfilter
yourformatter yourlexer yourmodule yourstyle yscrollincrement yusuke yuval zach zadoks zeuthen zijian zlibmodule aaaaa
aaaaabaaa aaab aaabbc abbccc abbcccdddd abcb abcdcba abcdefghi abcdfgilmnop abdirahim abedfxyz abilities ablaj
abstractmethod absurd acid acknowledgement acos actionable acton actool actor adaptability addindent addressees
addrspec adict adopter aforenamed afrikaans agenda ahmed aiff aitken aktuelles alberto aleksei algol alist allayed
alleged allotted allowcomments allowlist alphanum alphaword altchars altinstall ambitions america ample amsterdam
animated anticipation antony appendices approvals approximated arenotlegal argval arrowood artefact asin assistance
assists associations astream atomends atomics attard auch authenticity authtype autoexpand autolink autolinks autoload
autoloaded automagic autoraise autoreset autoselection autospecced avenue averaging bake band banned bauer beginchar
belarusian bengl bersac betroffenheit bidoul bigobject billing bingle binop birthtime bitsize bjornson blahfooblah
blamed bleeding blend bletch blown bmeck bodyline boneskull boosting boot botching bottoms bradnelson brands
brendanashworth brik broman brotlipy browsed brute bundler bundlers bungle burlap burst butthey bytelen bzoz calcsize
carlier casefolded casey castle catalan catchall catched cbname cdrom centerpoint centralised centralize centred
certified certify cgitb champion changelist chatty checkdir cheese chews chickens choking chowning chung circa
circumflex circumvented clara clashing classprefix claudiorodriguez clearintervaltimeout cleartimeouttimeout clocks
cloudpickle cmdname codesets codesign codetag coeff collaborating colornames coloured comb combos commandchars
commandprefix commonwealth compability compelling compendium compensation composability compositing concisely
conformed conjoin conjugate consolidates consumable containee contaminating contextify contextualizing contiguity
contracted controllers convergent cooperating coprime copyedit copyrighted corp corrupting countable counterproposal
countstr court crawford crazily crlfs croatian crud crufty crumb cssclass cssfile cssstyles ctext culprit customarily
cutoffs cwds cybermapper cycling cyclonedx cygwinccompiler dancing daniels darren dashed datapassing datum davisjam
dayname deallocs debugobj deco deconstruction decref dedents dedup defaultaction defective definite degrees delivering
denicola denom dert descendents descent descrobject deselects deseret deserializes despises detrimental deviate
devmajor devminor devstudio diacritical diacriticals diagnosis diagrams diamond diaz dice dictview dictviews dill
directional directoriesbin dirlist disaggregates disasters discipline disclaims discriminate dismissed displaychars
displaycolumns displayindices displaylines distorted diving divisions dkls dllname dllwrap dodge dogs dollars dolog
doodoo dotatoms doublecheck dover downright dozen driving dtext duplexify duplications dysfunction ecparam educated
efgh efraimidis egginfo electricity elementname elementwise elifs elinks ellinghouse emil emitters emptying endeth
endorsement endswith ensued entitlements eons epiphany erased eratosthenes erik errtest errtext escoto esoteric
estliberitas estonian etags ethan evalue eventtarget evolving exceptionally excited existings exitmsg exorbitant
experiencing explicitely expressive exprname extcode externals extname extralagefile extralargefile fakes fancyvrb
fastly faux fchmodat fchownat fext fgets fibgen fiddle fieldvalue fiji filetypes financial finger fingers finitely
finnish fintl firstn fixpoint fleck floordiv fmodern fmtchar fmter focusin focusout fontface fontfamily foodwatch
forbidding forge forgery formulating fortuitous francesco frange freaky freedoms fretting fried friedl frisch
fromshare fstrings ftest funclike gabrielschulhof gack gallagher gangc gateways gatsby gava gcomb geek gencopy genshi
georgian georgiou gerrit getbuf getbuffer getbufferproc getcode getdelimited getfloat getpager getphraselist
getprotobyname getpwall getroot gettimeout ghijk giant glasner glenkeane globstars gobbles goeth goodlines googlebot
gorez gots grafts grail grandchildren graves graymap greetings greets groks groupwise grown growth gujarati gupta
guten habitually hackers halves hammering hamming hardcoding hardened hardest hayes hazardous hazards headless heal
heapdump heredocs hideclosed highbit highlighters hiroppy hist hkps hoop hovering howmuch htmldecode htonl httponly
hunt huntrleaks hyperbolic ibanez idstring ignorant ignoreables ijklmnop ilan illustration ilya imageset imaging
imclass implementer inability inbound inch includeids inconsequential indexer indications inequalities inert infinitum
infringement initiating initlog injective inoue inpackage inputted insecurely insight inspiration instigated
interception interests internalstate interop interplaying intlmodule intsfrom investigated invokation ipnames
irritating irst iselement isnt isolating isomorphic iterkeyrefs itervaluerefs jasongin jeanluc jessica jhamhader
jhylton jithil joernchen johab juanarbol judicious jussi justifications jyasskin kaiser kanjis kconfig kedzierska
keyboards keyencoding keylen keymap keyrefs keyserver kfmclient khmer kirill kits klein klonfleisch knights knot
knowledgable kosher koziatinskii krah kunalspathak kurihara kvakil kwonlyargcount langname lasti latvian layoutspec
ldconfig leaker legends leniency leslie lexeme lexemes libblkid libcs liberate libintlmodule libmamba libnames libre
librep libuuid libxyz lineanchors linenospecial linenowidth lineseparator linespans lingl linkgoron listlen literature
livermore liyanage lkjsfd lksd llst lobject localport lockit locn logfp logrotate longhand lookaheads lookalike
lookuperror loper loren lousy lsdjjkf lsdkj lsdkjf lshape lsjdf lskdj lskjd lslices lspan luis luminance lundibundi
lurk luxury macholib maciej madness makelocalealias makevars mandarin manifesting manpages mapdict marketing
masquerade matchable matej mathescape matias maurice maxbytes maxchar maxim mboxmessage meck medians meld memlen
memlimit meson mestery metachars metamethod metatype michel micnic microtests midway mildsunrise military mimick
minors mint misconstrued misplaced missouri misspellings mitchell mockup modelines modpkginfo momtchev momtchil
monodimensional monofont monotonicity monster mortal motorola mounts mouseclick mscdex msgs msgstrs mspdbsrv msvc
muenzenmeyer mulligan multihomed multipliers musse mustard mustclose mutilate mycoll myenv myproj myregistrytoken
mysocket myuser nachrichten nacl nanny nawait nbits ndim nebrius necessity needsterminal nehal nephew nestable
neverending newchildren newframe newindex newobj newsgroup newsyslog newteam newterm nghi nicu nikhil nikita niklas
niyas nntp noam nobackground noclasses nodelay nodist nomination nonidentical nonnnegative nonterminals nopt nordgren
noticing notifier notneeded novel noway nowiki nswe ntlang ntohs nuke numrequests numword obfuscated objectid
objectreference objs obligatory observation observing occupy occurences ocean octlong oddly odegard oder offboarding
offscreen olde olivier onceregistry oneline onmessage operated oppose optgroup optimistically optval ordset organised
oriya osname ottype ouml outerboundary outerdir outlaws outlive overcome overlooked oversized overwhelming owen pabc
paepcke parallelize parcel parsedate passage passthru patchcheck patel patience pdict peekables peername penultimate
perceived periodicity perlre persisting petkaantonov petr philippe phrasing pile pinnable pixmaps platlibdir plusses
poly polygons ponnan popularity pose postprocess pragmatic prebuild preconditions preconfiguration preconfigured
predating predecessors predicts preinitialization prejudiced preprocesses prescanned prestyles presupposing prevailing
primed primordial processexecpath productdir progname proj proposes pros prototypically proxying pseudocode pstdev
ptrs pulsing pumps punc punctuated punted punycoded puppeteer purity putative puzpuzpuz pvariance pydecimal pyjnius
pymodeline pynexttest pyrepl pystate qard quanta quantified quentin queueing quickening quickselect quoteattr radd
raiser ramirez randomizer readd readwrite reak realfib realizes reallocate realnum realtime reappears reaps rebound
reciprocals rectangles recurs recycling redefinitions redistributable reducefunc reductions reese reevaluation refold
reftable regexec reilly reimplementations reinitialising reinstalls reinstated relaxes remapped remotehost remoteport
renegotiate replicates repositioned requestsocket reraises reservoir resetwarnings respectfully responsesocket reston
retreat revamp rexagod risky rlocate rlst robertkowalski robject rohan rollovers romaaan romankl ronag rootfd roslyn
roster roundings royalty rshape rslices rubys runcall ruyadorno saghul sait sale sanitizes sanitizing sara sarahan
saratoga sass saveopts scene schnell schools scissors scons screwed screwy scriptlet scrollwheel sdlkjf seamless
searchg secretstorage seishun selftests semi semiconvergent sepi serbocroatian sergeant setenv setext setfunc setopt
shah shapeof sheets shellcheck shelves sherwood shingo showsyntaxerror showtraceback shrug shute sidestep signable
signoff silliness silva silver simone simplefilter sinks sitedir sizegrip sjis sketch skewfactor skipitem skipto slant
sldjf sldkj sldkjf slicelen slim slimmer slipping sloppily slovak slovene slovenian smartquotes smolenchuk smuggle
sniffio snug socketunref socsecno sofar sophia sortdict sourceforge spacehack spamdict spamlist spammish specificity
speedy spends spinners spinning spits spoil sponsoring squashing srel sshurl sslcontext ssss ssssss sssst sstst sstt
stabilizing stall statespecs steam stefano stegun stemming stinner strace strcoll stresses stride striding strikeout
structseq strukchinsky strxfrm stutzbach stylename subclasshook subcontainers subdicts sublayout submenus
subnegotiations suboffsets subprocessdisconnect subtitle subtrees subwindow subwindows succs sucked suits sundance
superficial superior supersedes supress sutu sweet swig synchronizes syslogd sysout systemd systemwide tagalog
tagsfile tagurlformat tailing taiwan tarextdir technologies teedataobject templ tenuously teredo testcontext testname
testpatch testpath texcomments textarea themename thlorenz tiancheng ticker tightening tilded tile timerify titlecase
tldr tname tniessen tobytes toejam tokena tokenb tomfoolery tomorrow toolchains toplevels topsort trac train trample
tran transitively traverser treebuilder trev trevnorris triangles trims tsconfig tspan tstr tupleids turd tying
typeerror typemap typeobj typeobject typevars ubiquitous udcbb ulises umbrella umlauted unbacktrackable uncleanable
uncommenting unconsumed undecodeable undefines undefinition undefinitions understandability unexpanded unfollowable
unforeseen ungreedy ungrouped unheeded unicodefields unidata unifies unjoined unmanages unmaps unoptimized unsetting
untar untokenized untyped untz upcall urlfetch usecase usefully usegmt usepackage userhome userptr utcoffsets utter
valuably valuefunc valueless valuerefs vcbuildtools vcvars verboptions verfolgen verifications verison verre vfork
vimdiff virginia vladyslav vsevolod walter wani warped watilde waygood weakdict weakness weakproxies weeble weeding
whale whereupon wheter whichmodule whichside whittling wholly whomever widespread wing winsound wished witnessing wolf
wordcode worthless wrapcode wrapcolumn wrappable writabledestroyerror writeup wunder xattr xattrs xbar xbbd xmllib
xoffset xpixels xxmodule yanking yasskin yearly yhwang yoffset yoshiki ypixels ystep zadka zaps zawinski zebra zeroth
zhou abandoning abcdefghijkl abcdefghijklmnop abfnrtuvx abfnrtvx abundance accommodation accompanies accompany
ackerman aclosing addsitepackages admonition adns advancements advertises aenean aguilar aioe akash albanian albatross
aliquam aliquet alnum alphabetize alphabets altsep amendment amiga amplification andr andrei andruk anext animations
anycast anydbm appdirs appealing appendable approving approxidate aquatk arcane archival arggh arghghh argslist aring
arun asap asciidoc asciidoctor ashimine ashley assistant astring asyncgens asynctest atlassian attitude augie augue
authorizing autodata auxlib avocat azerbaijani azeri backspacing baggage bailey bails balloon banana bangs barber
basque bass bastardised bcpp bearing bees behavioural bengali benoit betancourt bgcol bibendum bickle bindingslist
binomial blithely blorb bock boldness bombs bond bong bons bookmark bosnian botched bounty bpformat branched brandt
brazilian british brotlicffi bsdglob buffersize buildno bunton burke burzakovskyy busting bytesize bytestream byuids
caldera calibrated calloc callstack cancelation careless carvalho cascades catcher cavage centos centralise cessation
cfgdata chao characteristic charbuffer chardata charter chatterjee cheapening checkbuttons checkcache chemi chia chin
china chokes chrominance cirrus citation citi clay cleansing cliff clips clisp closefile cloudlinux clumsy cmpfiles
codecname codemods coder coefficients coercible collectable collectively colliding colnames colocated colorless
commandstring commercially compacity comparision compdef compensating complementing complications composants comprise
conceal concert concretely concreteness confidently confronted congruent congue conservatively conspicuously consul
containerised contextified continental contingent conveying convolve cooper coordinated coordinator copyfileobj
copyleft copyrightable cosmetics cousin cpparg crack crawl creators cruncher crwn cscript customevent customlist dale
damian dangers daniluk dapibus datas datastructure dated daysecondsfrac deadlines debadree decamelize dedenting
dedications defense deferring degert delitem delphi delphiactual demos demoted dennis dershowitz descends deselect
destfile detaches deutsch devdir devious devnexen devpoll dfadf dhparam diasallow dictum differentiating dinv
disclaimers disclaiming discord discourse discriminators disposable disputes distb distcheck distinctive diverse
diversity docopen doctypes donating donec dostime drawbacks dumber dumper duncan dunders durable duties duty dwayne
eariler eastward eddy editline edwards eget eject elems elides elisey embeddable emergencies emph empirical emptor
emulations encapsulating encodability endcase endflag endfor endmarker endorsements engelbert engineer enrich enriched
entires envfile episode epler equipped equivalency erickson erroroffset ethical etre evaluator eventname evoking
examplescreen exampleturtle excepting exhaustively exherbo exhibiting expandable experiences explicity exploitable
expresses extendable extendleft extpage extrapolated fackler failobj fans fasel faucibus favourite favours fchmod
fcopyfile fearful feltman fenceposts fences fermentum ferror feugiat fflush fgcol fget fieldset fifteen figcaption
figtree filedialog filing findable finicky firmly fiveto flakey fledged flicking focal foldspaces folk fontlist
fontpage foobarbarfasel foobaz foonabulation foox forbes foremost formalize formalizes formatcode formatstr fqdn frac
francis freaking frog fromisocalendar fromordinal fseek ftext fumait fused futureproof galeon galician galindo ganguly
gaynor gced georgios getaliases getall getcapabilities getch getcontext getcwdu getname getpath getregentry gists
glentiki glitch globby gmake gnulib goaway godly goebel goesgens goingnative gonna gory goujat granting graphviz
greediness greenkeeper grist groupindex growable gtest guaranteeing guillaume guimard guise gutter hacker haering
halit harris harsh hartmut hauser hawk hazra headerify healthy heapsort heartening helpfully herbert herczeg hereunder
hermsmeier hernandez hextet hextets heydon hhmmss hiccup highpage himadri himadriganguly himself hlep hmmmm hogging
hollywood holowaychuk homedir hoopla hops horky hostaddr hostile hotkey housed hppa hugo hylton hynek hyperlinked
hyrum iansu icelandic ifilterfalse ignorechars ikko imman immediates impacting imperative impractical imprecision
incase inclination inclusively incrementaldecoder incrementalencoder incurring indentations indeterministic indic
induced induces ineffable influx informing initfsencoding initialising initstdio initzipimport innards innerboundary
innocent inqueue inroot insecurity insisted institute institutions insulate integrates intellisense interactivity
interdependencies interfered intermingles internalized interoperating interpretor invariance irix isinf ismount isnan
isntall isoweekday ispythonsource itani ivars izip jake jammed jamming jane janko jaworski jeeves jersey joern
johansson jointly jorge josef jsdoc jslint juggle junit kannada kantor keepends keller kenji kevan keydefs keydid
keyrings keyspage keystore keytype khong krishna kukkonen kurdish kvmibm kwajalein labeling lacus laden lagorsse
landscape lange langley laningham lapsley launchpad laura leaky leftright legible legibly lend levinson
lexicographical liberty libregrtest libsecret liked linelengths lingo linkifies linus linuxmint listbindings lldb
localizable localizations locatestarttagend logarithmic lolwat lookback lossage lossless loves lovingly lucid luctus
lukasa lunatic lurking luvaton lyle macedonian mackall macostools macpath mageia mailer mailman mainframe mainmodule
maipo makepasv makesetup maketree malayalam mamba manageable mandriva manufacturer maori marathi margalit martelli
martinez matrices mauris maxevents maxime mcsl mechanic medvedev memcpy memmove memoizes mergesort mert mesh
metavulnerabilities metavulnerability metavulnerable methodology michiel midi midyear miladfarca mileage miles
milestone milestones mille mimebundle miniters minority mipsel misbehaviour mishaps mistyped misused mnopqrstuvwx
mnopqrstuvwxyz monaco mongolian monitored monochrome monopolizing montanaro montonic morocco morton mountable
mountpoints msan msggen msvccompiler msys msysgit muentes mullusk multiauthor multiplies multiprocesses multithread
murphy musllinux mycmd mydict mydirectory mykey mymethod mynewcommand mypyc mythical nameprep namer nastiness natalie
navigator ncols necessitating neighbors neil neque netblocks netbsd netlify newsarticles newsgroups newtab newwin nhan
nicety niemeyer nils nobrace nocase noday nodeschool nodeset noext noglobstar noisily nominally noncommercially nones
nonull nothrow novelty nowak nunc obar obeyed obeying objection obstruct ocsp octave ofek offload ogunc omission ommit
onexc onread opacity openlog openpgp opensuse openwall optionx optlist oranges orchestrator orci originate osascript
oscar oscrypto osinfo oussoren outfp outlines outqueue overboard overlined overstrike ovflowd owed pace paine painted
pairings panva paradise parameterization parametrize paranoia pardoe parnham parseline passages pathdirnamepath pavlov
pdoc pedersen peeked peepholer pennington percentiles permille personally pertain perturbing petrov petrovic phantom
phantomjs pharetra philosophical picklers pidfile pidora pierre piman pings pinpointing piotr pitfall pivot players
pobegaylo pony portend portons positionment posixheader posonlyargcount possesses postimage postloop postprepare
posttest ppend pprints prawns precisions precludes predates preemptively prefetch prefinish preloop preprepare
prescriptive pretended pretium prettifies prevail primarosa printers prioritized prioritizing probabilistic
probabilities probing procedural processexitcode producers profilers proleptic protoype pseudoevent pthreads ptpython
pubkey pudding pujin pulkit pulldom pumpify puppy pushd putland pycs pyenv pyepat pygobject pyodide pypa pystrhex
pythonxx qrstuvwxyz quadruple qualms quicksort quijada quotations qwertydkjf racle raison ranked raspbian rating
readchar readermode readexactly readfunc readings realaudio realise reaping reapplying rearranged reassignment recalls
recolor recombine recommending reconstructed recreating redirector redist reenable reenters reentrance reexposed
refinement reflow regenerates regexs reingold reinit reinitializing reinstate reinvent reiterate relayed relaying
relicensing remained remediations remedy renderhook repercussions replicating repost reproduction requestdestroyerror
requote reseeded reshape residue respectful responsive retailers rethink retina retitle reviewers revising reviver
rewindable rexx rhel richer rieseberg rigid risus rivera rlhandler rocky rodsuwan rohit rootnode rotates rotator
routable runas rustc ruthlessly sabath sabotage salvage sameness sampleclass samplecmdclass santos sapien sapin
satisfactory sauce schedulers schlawack schneeweisz schneider scopeid sdata sdoc sebastien secondarily secondsfrac
secs selves selwyn senn serialise serialised servertimeout setcomps setparameters settitle sever sfile shades shaking
sheep shellwords shepherd shortname shout shrimp shuffles shuowang sick sideways silences silvester simen similarities
simulator sindresorhus sizelist sizing sles slowed sndhdr snider snip sntex socketbuffersize softspace sollicitudin
somecode sora sortedcontainers sparingly speculative spiders splitable splitchars sponsor sprinkles squirreled
sreepurnajasti sscript stabilizes stackoverflow stalling standardizes statfs staying stdcompleter stdscr stdtypes
steffen stein stephan sterbenz storable streamreader streamwriter street strerror strictest stringized stringlike
stringlist strokes structname structseqs structuree subapp subdependencies subdict subframes subgraph subnetmask
subprocesskillsignal subproject subsidiary substance subtrace subunit succinct sucky suraneti suspiciously sutherland
sylvain syntaxis syscmd tabbedpages tainted tajik talked tallied tangent tcsetattr tdocstring tearing telephone
telescoping telugu tens termcap testet testfiles textpad theodore thereafer theses thwart tiers tiled timo timouet
tincidunt titlepage tolerates toolwindow toordinal topbottom townsend transmits traversables trickiest trusts ttabs
ttinfo tuesdays turtlegraphics typecast typographical ufffd unaccounted unanswered unassociated unavoidably uncleanly
underlies underlines undetectable undobuffersize undoing unescapes unexpecting unexplainable unflatten unhappy
unicodeobject unindented uninterpreted uninterrupted unixen unixtime unlabeled unlinker unpredictably unprefixed
unrecognised unrefed unrestricted unsatisfactory unsent unserialize unshift unspellable unstyled untabified untraced
untransformed untranslatable unvisited unwelcome unwinding uptime usefrozen usercustomize userlist userprofile
userspace utilparseargsconfig uvloop uxxxx vadim vals vectorcall velocity venvlauncher vergani versioninfo vminfo
voluminous voluntary volunteer vrbls vulns waldman walloon walrus wanna wantobjects warang warner wart watchman
weirdness westerhoff whatwg wheelhouse whiskys wholesale whos wilcox wildmatch wilfried wince windir wirzenius wisdom
withitem wolfram wonky wood woodward wordlist workable workerterminate worlds wrapcol writabledestroyed writeln
xcalloc xdigit xenserver xgtitle xmlparser xmode xover xyzzy yuan zanko zdump zessin zeyu zipp zoltan zoomheight ztar
""".split()
