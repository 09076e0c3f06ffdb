"""Dictionaries of the audits."""

# Results depend on each of them.
TERMS = (
    "ACID API ArrayList Arrays BigDecimal BigInteger Boolean BufferedReader CRUD Character Class Collection Collections Comparable "
    "Comparator Connection DNS Date DependencyInjection Double DriverManager EnumMap EnumSet Error Exception FIFO File FileStore Float "
    "FunctionalInterface HTTP HTTPS HashMap HashSet IP InputStream Integer Iterable Iterator JAR JDBC JDK JSON JVM JumboEnumSet LIFO Lambda "
    "LinkedList List LocalDate LocalDateTime Long Map Math ORM Object Optional OutputStream Reader RegularEnumSet ResultSet Runnable Runtime "
    "RuntimeException SQL SSL ServiceLoader Set StackWalker Statement Stream String System TCP TLS Thread Throwable TreeMap TreeSet UDP URI "
    "URL WAR Writer XML abstract assert class clone compareTo decorator enum equals final flyweight getClass getInstance hashCode immutable "
    "interface native newInstance notify notifyAll observer private protected public singleton static synchronized toString transient "
    "valueOf volatile wait"
).split()

#: In order; valueOf occurs twice.
IDENTIFIERS = (
    "Boolean String Integer BigInteger EnumSet RegularEnumSet JumboEnumSet Collections Comparator List Set Map ServiceLoader DriverManager "
    "Connection StackWalker Array Files FileStore BufferedReader DoubleBinaryOperator valueOf toString getInstance valueOf compareTo "
    "applyAsDouble"
).split()

CONCEPTS = [
    ("static factory method", "静态工厂方法"),
    ("constructor", "构造器"),
    ("singleton", "单例"),
    ("immutable", "不可变"),
    ("instance-controlled", "实例受控"),
    ("service provider framework", "服务提供者框架"),
    ("Flyweight pattern", "享元模式"),
    ("builder pattern", "构建器模式"),
    ("telescoping constructor", "伸缩构造器"),
    ("functional interface", "函数式接口"),
    ("lambda", "lambda"),
    ("type inference", "类型推断"),
]

# Named examples of the documented term detector, by category.
CATEGORIES = {
    "acronym": "GPU CPU LLM API HTTP JSON".split(),
    "model": "GPT-4 Claude Llama BERT Mistral".split(),
    "framework": "TensorFlow PyTorch React Django".split(),
    "language": "Python JavaScript Go Rust".split(),
    "protocol": "HTTP HTTPS TCP IP DNS SSL".split(),
}
