"""The attribute ontology: canonical attributes, their labels in several languages, and the dictionaries built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.functions.text import normalized_label

VERSION = 2

# Attribute | category | canonical unit | allowed units | least and greatest value | English and Ukrainian
# name | further labels. The key with spaces for underscores and both names are labels too.
ATTRIBUTES = """
net_weight | headphones | g | g kg mg oz lb | 0 500000 | Net weight | Вага нетто | weight; mass; вага; маса; вес; вес нетто
battery_life | headphones | h | h min s | 0 1000 | Battery life | Час автономної роботи | battery; автономність; час роботи; время работы
ip_rating | headphones | - | - | - | IP rating | Клас захисту | ip; protection class; степень защиты
bluetooth_version | headphones | - | - | - | Bluetooth version | Версія Bluetooth | bluetooth; версия bluetooth
color | headphones | - | - | - | Color | Колір | colour; цвет
material | headphones | - | - | - | Material | Матеріал | материал
socket | cpu | - | - | - | Socket | Сокет | cpu socket; processor socket; socket type; sockets supported; supported sockets; процесорний роз'єм
memory_type | component | - | - | - | Memory type | Тип пам'яті | type of memory; тип памяті
tdp | component | w | w kw | 0 2000 | TDP | Тепловиділення (TDP) | thermal design power; default tdp; processor base power; power consumption; tgp; total graphics power; тепловиділення
screen_size | monitor | in | in | 0 200 | Screen size | Діагональ екрана | display size; panel size; diagonal; screen diagonal; діагональ; розмір екрана
chipset | motherboard | - | - | - | Chipset | Чипсет | чіпсет
form_factor | motherboard | - | - | - | Form factor | Форм-фактор | форм фактор
memory_slots | motherboard | slots | - | 0 32 | Memory slots | Слоти пам'яті | dimm slots; number of memory slots; ram slots
max_memory | motherboard | gb | gb mb tb | 0 8192 | Max memory | Макс. пам'ять | maximum memory; memory max; max capacity; максимум пам'яті
resolution | monitor | - | - | - | Resolution | Роздільна здатність | max resolution; maximum resolution; native resolution
refresh_rate | monitor | hz | hz khz | 0 1000 | Refresh rate | Частота оновлення | max refresh rate; maximum refresh rate
panel_type | monitor | - | - | - | Panel type | Тип матриці | panel; matrix type; матриця
response_time | monitor | ms | ms s | 0 1000 | Response time | Час відгуку | gtg; grey to grey
ram | laptop | gb | gb mb tb | 0 4096 | RAM | Оперативна пам'ять | system memory; installed memory; installed ram; озп
storage | laptop | gb | gb mb tb | 0 1048576 | Storage | Накопичувач | storage capacity; ssd; ssd capacity; disk
cpu_model | laptop | - | - | - | Processor | Процесор | cpu; processor model
gpu_model | laptop | - | - | - | Graphics | Відеокарта | graphics card; video card; graphics processor
gpu_memory | gpu | gb | gb mb | 0 1024 | Video memory | Відеопам'ять | graphics memory; memory size; vram; обсяг відеопам'яті
gpu_boost_clock | gpu | mhz | mhz ghz | 0 100000 | GPU boost clock | Boost-частота GPU | boost clock; boost clock speed; game clock
gpu_cores | gpu | cores | - | 0 100000 | GPU cores | Ядра GPU | cuda cores; stream processors; shading units
interface | gpu | - | - | - | Interface | Інтерфейс | bus interface; pci express; pcie
cores | cpu | cores | - | 0 256 | Cores | Кількість ядер | total cores; number of cores; core count; of cores; ядра
threads | cpu | threads | - | 0 512 | Threads | Кількість потоків | total threads; number of threads; thread count; of threads; потоки
cpu_base_clock | cpu | ghz | ghz mhz | 0 100 | Base clock | Базова частота | base frequency; processor base frequency; base clock speed
cpu_boost_clock | cpu | ghz | ghz mhz | 0 100 | Max turbo frequency | Turbo-частота | maximum turbo frequency; turbo frequency; max turbo; boost frequency; турбо частота
cache | cpu | mb | mb kb | 0 4096 | Cache | Кеш | l3 cache; smart cache; intel smart cache
"""

# Category paths.
CATEGORIES = {
    "headphones": ["electronics", "audio", "headphones"],
    "motherboard": ["components", "motherboard"],
    "monitor": ["electronics", "monitor"],
    "laptop": ["electronics", "laptop"],
    "gpu": ["components", "graphics_card"],
    "cpu": ["components", "cpu"],
    "component": ["components"],
}

SCHEMA = """attribute_key string, ordinal int, category_path array<string>, name_en string, name_uk string, data_type string,
canonical_unit string, allowed_units array<string>, min_value double, max_value double, ontology_version int, synonyms array<string>"""


def _rows() -> list[tuple]:
    out = []
    for i, line in enumerate(ATTRIBUTES.strip().splitlines()):
        key, category, unit, allowed, bounds, en, uk, labels = (x.strip() for x in line.split("|"))
        low, high = (float(x) for x in bounds.split()) if bounds != "-" else (None, None)
        names = [x.strip() for x in labels.split(";") if x.strip()]
        out.append((
            key, i, CATEGORIES[category], en, uk, "text" if unit == "-" else "quantity", None if unit == "-" else unit,
            [] if allowed == "-" else allowed.split(), low, high, VERSION, [key.replace("_", " "), *names],
        ))
    return out


def ontology(spark: SparkSession) -> DataFrame:
    """All attributes, 31 rows: bounded, so broadcasting them is safe."""
    return spark.createDataFrame(_rows(), SCHEMA)


def attributes(spark: SparkSession) -> DataFrame:
    """What the attribute listing shows: no bounds, no labels."""
    return ontology(spark).select(
        "attribute_key", "category_path", "name_en", "name_uk", "data_type", "canonical_unit", "allowed_units", "ontology_version",
    ).orderBy("attribute_key")


def labels(onto: DataFrame) -> DataFrame:
    """(label, attribute_key, ordinal), a row for each normalised label, to be broadcast; of a label's attributes the last wins."""
    every = onto.select("attribute_key", "ordinal", F.explode(F.concat(F.array(F.col("attribute_key")), "synonyms", F.array("name_en", "name_uk"))).alias("label"))
    every = every.select(normalized_label(F.col("label")).alias("label"), "attribute_key", "ordinal").where("label <> ''")
    return F.broadcast(every.groupBy("label").agg(F.max_by("attribute_key", "ordinal").alias("attribute_key"), F.max("ordinal").alias("ordinal")))


def with_learned(labels_df: DataFrame, learned: DataFrame | None) -> DataFrame:
    """The label dictionary, with learned mappings (raw_attribute, attribute_key, confirmed_at) before the built-in ones; the latest wins (ties: the greater key)."""
    known = labels_df.select("label", "attribute_key")
    if learned is None:
        return known
    new = learned.select(normalized_label(F.col("raw_attribute")).alias("label"), "attribute_key", "confirmed_at").where("label <> ''")
    new = new.groupBy("label").agg(F.max_by("attribute_key", F.struct("confirmed_at", "attribute_key")).alias("attribute_key"))
    return new.unionByName(known.join(new.select("label"), "label", "left_anti"))


def learn_mappings(confirmations: DataFrame) -> DataFrame:
    """Upserts of (raw_attribute, language, category_path): the latest confirmation of each key (ties: the greater attribute)."""
    last = Window.partitionBy("raw_attribute", "language", "category_path").orderBy(F.desc("confirmed_at"), F.desc("attribute_key"))
    return confirmations.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def mapping(mappings: DataFrame, raw_attribute: str, language: str, category_path: list[str]) -> DataFrame:
    """The mapping of one key, if there is one."""
    return mappings.where((F.col("raw_attribute") == raw_attribute) & (F.col("language") == language) & (F.col("category_path") == F.array(*map(F.lit, category_path))))
