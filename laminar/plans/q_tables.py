"""Queries over names, calibration, measurements and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import numeric as Q
from ..operators import joins as J
from ..operators import measure as M
from ..session import table
from ..sources import metadata as MD
from ..sources import photos as P
from .registry import query

# --- shared fixtures (one SQL text serves both engines) ----------------------

FRAGMENTS = """select concat(cast(l_orderkey as varchar(20)), '_leaf.png') image_name, l_linenumber frag,
  cast(l_quantity as bigint)*100 leaf_area_px, cast(l_quantity as bigint)*cast(round(l_discount*100) as bigint) damage_px
 from lineitem"""
NAMES = """select o_orderkey k, cast(o_orderkey%6 as int) rule_no,
  concat('P', cast(o_orderkey as varchar(20)), case cast(o_orderkey%6 as int) when 2 then '_white_bg' when 3 then '_white_bg' when 4 then '_leaf_2' else '' end, '.png') image_name
 from orders"""
SCALE_REF = """select concat('P', cast(o_orderkey as varchar(20)), case cast(o_orderkey%6 as int) when 0 then '.png' when 3 then '.jpg' else '' end) ref_key,
  cast(1+o_orderkey%7 as double)/10000 cm2_per_px2
 from orders where o_orderkey%6 <> 5"""
SEG_META = """select concat('P', cast(c_custkey as varchar(20))) image_id, cast(4+c_custkey%8 as double)/16 scale_factor, cast(1.0 as double) pre_scale,
  case when c_custkey%9=0 then 'derived_image' else 'original_photo' end scale_source,
  c_custkey%4<>0 as found, c_custkey%10=0 as low_confidence,
  cast(20+c_custkey%30 as double) diameter_px, cast(28.0 as double)/cast(300+c_custkey%500 as double) mm2_per_px2
 from customer"""
OVERRIDES = """select concat('P', cast(c_custkey as varchar(20))) image_id,
  case when c_custkey%12=1 then cast(0.0 as double) else cast(25+c_custkey%20 as double) end diameter_px
 from customer where c_custkey%6=1"""
EDITS = """select concat('P', cast(user_id as varchar(20)), '.png') image_name, event_id seq, event_type op, cast(floor(value) as bigint) damage_px from events"""
TRAINING = """select case when p_partkey%3=0 then 'big' else 'small' end dataset, concat(case when p_partkey%3=0 then 'big_' when p_partkey%3=1 then 'small_' else '' end, 'leaf', cast(cast(floor(p_partkey/8) as bigint) as varchar(20)),
  case cast(p_partkey%6 as int) when 1 then '_r90' when 2 then '_r180' when 3 then '_r270' when 4 then '_fh' when 5 then '_fv' else '' end,
  '_v0', cast(p_partkey%8 as varchar(20))) stem, concat('leaf', cast(cast(floor(p_partkey/8) as bigint) as varchar(20))) expected_leaf_id from part"""
# names in every shape the parsers meet
STEMS = """select o_orderkey k, concat(case when o_orderkey%4=0 then '' else 'IMG_' end, cast(o_orderkey as varchar(20)),
  case cast(o_orderkey%8 as int) when 1 then '_white_bg' when 2 then '_WHITE_BG' when 3 then '_white_bg_leaf_03_white_bg' when 4 then '_leaf_2' when 5 then '_art_nicks' when 6 then '_White_Bg_leaf_1' else '' end) stem,
  case cast(o_orderkey%5 as int) when 0 then '.png' when 1 then '.JPG' when 2 then '.tiff' when 3 then '.webp' else '.txt' end ext
 from orders"""


def sql(spark, sf, text, *tables):
    """Run a shared fixture text over the given tables."""
    names = tables or ("lineitem", "orders", "customer", "events", "part")
    for t in names:
        if t in text:
            table(spark, sf, t).createOrReplaceTempView(f"_lm_{t}")
            text = text.replace(f"from {t}", f"from _lm_{t}")
    return spark.sql(text)


# --- names --------------------------------------------------------------------


@query(
    f"""select k, stem, regexp_replace(regexp_replace(stem, '_white_bg_leaf_[0-9]+_white_bg$', '', 'i'), '_white_bg$', '', 'i') leaf_id,
 regexp_matches(stem, '_white_bg_leaf_[0-9]+_white_bg$', 'i') nested, contains(lower(stem),'_white_bg') isolated,
 lower(ext) in ('.png','.jpg','.jpeg','.tif','.tiff','.bmp') and not contains(stem,'_art_') original,
 try_cast(nullif(regexp_extract(stem,'^[0-9]+'),'') as bigint) number,
 nullif(regexp_extract(stem,'^(.+)_leaf_[0-9]+$',1,'i'),'') parent from ({STEMS})"""
)
def name_parsing(spark, sf):
    s = sql(spark, sf, STEMS)
    name = F.concat("stem", "ext")
    return s.select(
        "k", "stem",
        N.canonical_leaf_id("stem").alias("leaf_id"),
        N.is_nested_dup("stem").alias("nested"),
        N.is_preextracted("stem").alias("isolated"),
        N.is_original(name).alias("original"),
        N.photo_number(name).alias("number"),
        N.parent_photo("stem").alias("parent"),
    )


@query(
    """select p_partkey, concat('photo', p_size, '_leaf_', p_partkey%9) name,
 row_number() over (partition by p_brand order by lpad(cast(p_size as varchar),9,'0'), lpad(cast(p_partkey%9 as varchar),9,'0'), p_partkey)::int pos from part"""
)
def natural_order(spark, sf):
    from pyspark.sql.window import Window as W

    p = table(spark, sf, "part")
    name = N.leaf_stem(F.concat(F.lit("photo"), "p_size"), F.col("p_partkey") % 9)
    w = W.partitionBy("p_brand").orderBy(N.natural_key("name"), "p_partkey")
    return p.withColumn("name", name).select("p_partkey", "name", F.row_number().over(w).alias("pos"))


@query(f"select stem, expected_leaf_id leaf_id, regexp_replace(stem,'_v0[0-9]$','') clean from ({TRAINING})")
def training_names(spark, sf):
    return sql(spark, sf, TRAINING).select("stem", N.training_leaf_id("stem").alias("leaf_id"), N.clean_stem("stem").alias("clean"))


@query(
    """select l_orderkey, l_linenumber, round(cast(l_quantity*997 as bigint)/cast(l_extendedprice*0+1013 as double), 3) pct,
 printf('%.3f', cast(l_quantity*997 as bigint)/1013.0::double) shown,
 case when l_linenumber%3=0 then null when l_linenumber%3=1 then l_quantity else null end sf,
 case when l_linenumber%3=1 then cast(l_quantity as bigint) else 7 end si from lineitem"""
)
def rounding_and_casts(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity").cast("string")).otherwise("n/a")
    v = (F.col("l_quantity") * 997).cast("bigint") / F.lit(1013.0)
    return li.select(
        "l_orderkey", "l_linenumber", Q.round_pct(v).alias("pct"), Q.fmt_pct(v).alias("shown"),
        Q.safe_float(text).alias("sf"), Q.safe_int(text, 7).alias("si"),
    )


@query(
    """select o_orderkey, case when o_orderkey%3=0 then concat('P',o_orderkey,'  |  Damage: ',printf('%.3f',(o_orderkey%1000)/8.0::double),'%')
 else concat('P',o_orderkey, chr(10),'Damage: ',printf('%.3f',(o_orderkey%1000)/8.0::double),'%  |  ',printf('%.2f',(o_orderkey%977)*0.0031417::double),' cm²') end title from orders"""
)
def damage_titles(spark, sf):
    o = table(spark, sf, "orders")
    scale = F.when(F.col("o_orderkey") % 3 != 0, F.lit(0.0031417))
    return o.select("o_orderkey", Q.damage_title(F.concat(F.lit("P"), "o_orderkey"), (F.col("o_orderkey") % 1000) / 8.0, F.col("o_orderkey") % 977, scale).alias("title"))


# --- sources --------------------------------------------------------------------

_HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "49492A00", "424D3A00", "524946460000000057454250", "000000186674797068656963", "00112233", "4749"]
_FORMATS = ["JPEG", "PNG", "GIF", "TIFF", "BMP", "WEBP", "HEIF", None, None]
_EXTS = [".jpg", ".txt", ".gif", ""]


def _case(expr, vals):
    arms = " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(vals))
    return f"case cast({expr} as int) {arms} end"


def _files(spark, sf):
    d = table(spark, sf, "documents")
    head = F.expr(f"unhex({_case('doc_id % 9', _HEADS)})")
    # the last kind is a file shorter than any header
    content = F.when(F.expr("doc_id % 9 = 8"), head).otherwise(F.concat(head, F.encode("text", "UTF-8")))
    name = F.concat(F.lit("photo"), F.col("doc_id").cast("string"), F.expr(_case("doc_id % 4", _EXTS)))
    return P.with_magic(d.select(name.alias("name"), content.alias("content")))


@query(
    f"""select concat('photo', doc_id, {_case('doc_id % 4', _EXTS)}) "name", {_case('doc_id % 9', _FORMATS)} magic,
 doc_id%4 in (0,2) or doc_id%9 < 6 is_photo from documents"""
)
def photo_format_sniffing(spark, sf):
    return _files(spark, sf).select("name", "magic", P.is_photo().alias("is_photo"))


@query(
    f"""select * from (select concat('photo', doc_id, {_case('doc_id % 4', _EXTS)}) "name",
 case when doc_id%9=6 then 'HEIF content needs a HEIF reader'
      when doc_id%9 in (7,8) then 'unsupported or corrupt image'
      when doc_id%4=1 then concat('content is ', {_case('doc_id % 9', _FORMATS)}, ', extension is .txt')
      when doc_id%4=3 then concat('content is ', {_case('doc_id % 9', _FORMATS)}, ', extension is (none)') end reason from documents) where reason is not null"""
)
def photo_format_issues(spark, sf):
    return P.format_issues(_files(spark, sf)).select("name", "reason")


@query(
    """select concat('P', c_custkey) image_id, case when c_custkey%5=0 then null else (4+c_custkey%8)/16.0::double end scale_factor,
 case when c_custkey%7=0 then 2.0::double else 1.0::double end pre_scale,
 case when c_custkey%9=0 then 'derived_image' else 'original_photo' end scale_source,
 c_custkey%4<>0 as found, (20+c_custkey%30)::double diameter_px from customer where c_custkey%13<>0"""
)
def metadata_json(spark, sf):
    c = table(spark, sf, "customer")
    parts = [
        "'{\"image_id\":\"P', cast(c_custkey as string), '\"'",
        "case when c_custkey%5=0 then '' else concat(',\"scale_factor\":', cast((4+c_custkey%8)/16.0D as string)) end",
        "case when c_custkey%7=0 then ',\"pre_ratio\":[2.0,2.0]' else '' end",
        "case when c_custkey%9=0 then ',\"scale_source\":\"derived_image\"' else '' end",
        "',\"circle\":{\"found\":', cast(c_custkey%4<>0 as string), ',\"diameter_px\":', cast(20+c_custkey%30 as string), '}'",
        "case when c_custkey%13=0 then ',,' else '}' end",
    ]
    doc = F.expr("concat(" + ", ".join(parts) + ")")
    meta = MD.usable_meta(c.select(MD.parse_seg_meta(doc).alias("m")).select("m.*"))
    return meta.select("image_id", "scale_factor", "pre_scale", "scale_source", F.col("circle.found").alias("found"), F.col("circle.diameter_px").alias("diameter_px"))


@query(
    """select concat('P', o_orderkey, '.png') ref_key, (1+o_orderkey%7)::double cm2_per_px2 from orders
 union all select concat('Q', o_orderkey) ref_key, 0.5::double from orders where o_orderkey%2=0"""
)
def scale_map_json(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.expr(
        "concat('{\"P', o_orderkey, '.png\":', 1+o_orderkey%7, ',\"_orig_dims\":{\"w\":3},\"Q', o_orderkey, '\":', case when o_orderkey%2=0 then '0.5' else '\"none\"' end, '}')"
    )
    return MD.parse_scale_ref(o.select(doc.alias("value")))


@query(
    """select concat('P', c_custkey) image_id, (c_custkey%50)::double cx, (c_custkey%40)::double cy,
 case when c_custkey%12=1 then 0.0::double else (25+c_custkey%20)::double end diameter_px from customer"""
)
def overrides_json(spark, sf):
    c = table(spark, sf, "customer")
    doc = F.expr(
        "concat('{\"P', c_custkey, '\":{\"center_px\":[', c_custkey%50, ',', c_custkey%40, '],\"method\":\"manual\",\"diameter_px\":', case when c_custkey%12=1 then '\"wide\"' else cast(25+c_custkey%20 as string) end, '}}')"
    )
    return MD.parse_overrides(c.select(doc.alias("value")))


# --- joins ----------------------------------------------------------------------

_IMGS = """select concat('L', cast(o_orderkey as varchar(20)), case cast(o_orderkey%4 as int) when 0 then '_white_bg' when 3 then '_white_bg_leaf_01_white_bg' else '' end, '.png') image_name from orders
 union all select concat('L', cast(o_orderkey as varchar(20)), '.jpeg') image_name from orders where o_orderkey%3=0"""
_MSKS = """select concat('L', cast(o_orderkey as varchar(20)), case when o_orderkey%2=0 then '_white_bg' else '' end, '_mask.png') mask_name from orders where o_orderkey%5<>0"""
_PAIR_CTE = f"""i as (select image_name, regexp_replace(regexp_replace(image_name,'\\.[^.]*$',''),'_white_bg$','') leaf_id from ({_IMGS}) where not contains(image_name,'_leaf_01_')),
 m as (select regexp_replace(regexp_replace(mask_name,'_mask\\.png$',''),'_white_bg$','') leaf_id, mask_name from ({_MSKS}))"""


@query(
    f"""with {_PAIR_CTE} select leaf_id, image_name, mask_name from (select *, row_number() over (partition by leaf_id order by length(image_name), image_name) r from i join m using (leaf_id)) where r=1"""
)
def image_mask_pairs(spark, sf):
    return J.pair_images_masks(sql(spark, sf, _IMGS), sql(spark, sf, _MSKS))[0]


@query(f"with {_PAIR_CTE} select leaf_id, image_name from i where leaf_id not in (select leaf_id from m)")
def images_without_mask(spark, sf):
    return J.pair_images_masks(sql(spark, sf, _IMGS), sql(spark, sf, _MSKS))[1].select("leaf_id", "image_name")


_EXTN = """select concat('L', cast(cast(floor(o_orderkey/6) as bigint) as varchar(20)), case cast(o_custkey%6 as int) when 0 then '.webp' when 1 then '.PNG' when 2 then '.jpg' when 3 then '.tif' when 4 then '.heic' else '' end) "name" from orders"""


@query(
    f"""select stem, "name" from (select *, row_number() over (partition by stem order by r, "name") n from (
 select distinct "name", regexp_replace("name",'\\.[^.]*$','') stem, case lower(regexp_extract("name",'\\.[^.]*$')) when '.png' then 0 when '.jpg' then 1 when '.tif' then 4 when '.webp' then 6 when '.heic' then 10 else 12 end r from ({_EXTN}))) where n=1"""
)
def extension_preference(spark, sf):
    return J.pick_by_extension(sql(spark, sf, _EXTN.replace('"name"', "name")))


@query(
    f"""select leaf_id, min("name") "name" from (select image_name "name", regexp_replace(regexp_replace(image_name,'\\.[^.]*$',''),'_white_bg$','') leaf_id from ({_IMGS}) where not contains(image_name,'_leaf_01_')) group by leaf_id"""
)
def first_image_per_leaf(spark, sf):
    return J.dedupe_first(sql(spark, sf, _IMGS).withColumnRenamed("image_name", "name"))


@query(
    f"""select image_name, cm2_per_px2, case rule_no when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 else null end "rule" from (
 select n.image_name, n.rule_no, s.cm2_per_px2 from ({NAMES}) n left join (select (1+o_orderkey%7)::double/10000 cm2_per_px2, o_orderkey k from orders where o_orderkey%6<>5) s using (k))"""
)
def scale_lookup(spark, sf):
    # rule 0 photos are listed twice over: "P6.png" is also the stem-with-extension of "P6"
    return J.lookup_scale(sql(spark, sf, NAMES).select("image_name"), sql(spark, sf, SCALE_REF))


@query(
    f"""select image_name, case when rule_no in (4,5) then null else cm2_per_px2 end cm2_per_px2, case when rule_no<4 then rule_no else null end "rule" from (
 select n.image_name, n.rule_no, s.cm2_per_px2 from ({NAMES}) n left join (select (1+o_orderkey%7)::double/10000 cm2_per_px2, o_orderkey k from orders) s using (k))"""
)
def scale_lookup_without_parent(spark, sf):
    return J.lookup_scale(sql(spark, sf, NAMES).select("image_name"), sql(spark, sf, SCALE_REF), parent_step=False)


_BUILD = f"""select m.image_id, case when o.image_id is not null then case when not o.d>0 then 'invalid_override' when m.scale_source<>'original_photo' then 'override_not_mappable' else 'manual' end
 when not m.found then 'no_circle' else 'detected' end reason, o.d, m.scale_factor, m.mm2_per_px2
 from ({SEG_META}) m left join (select image_id, diameter_px d from ({OVERRIDES})) o on o.image_id=m.image_id"""


@query(
    f"""select image_id, reason, round(case reason when 'manual' then (pi()*9.0)/(pi()*(d/2)*(d/2))/100.0/(scale_factor*scale_factor)
 when 'detected' then mm2_per_px2/100.0/(scale_factor*scale_factor) end, 10) cm2_per_px2 from ({_BUILD})"""
)
def scale_calibration(spark, sf):
    return J.build_scale_ref(sql(spark, sf, SEG_META), sql(spark, sf, OVERRIDES)).withColumn("cm2_per_px2", F.bround("cm2_per_px2", 10))


@query(
    f"""select concat(image_id,'.jpg') image_name, round(case when scale_source='original_photo' then 0.2827/(pi()*(diameter_px/2)*(diameter_px/2))/(scale_factor*scale_factor) end, 10) cm2_per_px2 from ({SEG_META})"""
)
def scale_from_photo_scan(spark, sf):
    meta = sql(spark, sf, SEG_META)
    scan = J.scan_scale(meta.select(F.concat("image_id", F.lit(".jpg")).alias("image_name"), "diameter_px"))
    none = J.build_scale_ref(meta.withColumn("found", F.lit(False)), sql(spark, sf, OVERRIDES).where("diameter_px < 0"))
    return J.scale_from_scan(none, scan, meta).withColumn("cm2_per_px2", F.bround("cm2_per_px2", 10))


_CLEAN = f"select distinct dataset, regexp_replace(stem, '_v0[0-9]$', '') stem from ({TRAINING}) where right(stem,1) in ('0','2','4','6')"


@query(f"select d.dataset, d.stem damaged_stem, c.stem clean_stem from ({TRAINING}) d join ({_CLEAN}) c on c.dataset=d.dataset and c.stem=regexp_replace(d.stem,'_v0[0-9]$','')")
def training_pairs(spark, sf):
    return J.mask_pairs(sql(spark, sf, TRAINING), sql(spark, sf, _CLEAN))[0]


@query(f"select d.dataset, count(*)::bigint n_pairs from ({TRAINING}) d join ({_CLEAN}) c on c.dataset=d.dataset and c.stem=regexp_replace(d.stem,'_v0[0-9]$','') group by 1")
def training_pair_counts(spark, sf):
    return J.mask_pairs(sql(spark, sf, TRAINING), sql(spark, sf, _CLEAN))[1]


_RES = """select concat('L', cast(o_orderkey as varchar(20)), '.png') image_name, cast(1000+o_orderkey%5000 as varchar(20)) leaf_area_px,
 cast((o_orderkey%800)/cast(8 as double) as varchar(20)) damage_pct, case when o_orderkey%3=0 then cast((o_orderkey%64)/cast(8 as double) as varchar(20)) else '' end leaf_area_cm2, cast(null as varchar(20)) damage_cm2 from orders"""
_META = """select concat('L', cast(o_orderkey as varchar(20))) stem, 2000+o_orderkey%3000 leaf_area_px, o_orderkey%2500 damage_px,
 cast((o_orderkey%80)/cast(4 as double) as double) damage_pct, case when o_orderkey%4=0 then cast(null as double) else cast((1+o_orderkey%16)/cast(1024 as double) as double) end scale_cm2_per_px from orders where o_orderkey%2=0"""


@query(
    f"""with j as (select r.image_name, m.stem is not null has, coalesce(m.leaf_area_px, r.leaf_area_px::bigint)::bigint leaf_area_px,
  coalesce(m.damage_pct, r.damage_pct::double) p, m.damage_px md, m.scale_cm2_per_px s, nullif(r.leaf_area_cm2,'')::double rc
  from ({_RES}) r left join ({_META}) m on m.stem=replace(r.image_name,'.png','')),
 k as (select *, (case when has then md else round_even(leaf_area_px*p/100.0,0) end)::bigint damage_px from j)
 select image_name, leaf_area_px, damage_px, greatest(0,leaf_area_px-damage_px)::bigint undamaged_px, round(p,3) damage_pct, round(greatest(0.0,100.0-p),3) undamaged_pct,
 round(s,8) scale_cm2_per_px, case when s is not null then round(coalesce(rc,leaf_area_px*s),4) end leaf_area_cm2,
 case when s is not null then round_even(damage_px*s,4) end damage_cm2, round_even(greatest(0,leaf_area_px-damage_px)*s,4) undamaged_cm2 from k"""
)
def measurement_export(spark, sf):
    return J.build_measurements(sql(spark, sf, _RES), sql(spark, sf, _META))


@query(
    """select p.p_partkey, concat('P', cast(floor(p_partkey/20) as bigint)) photo_id, c.d diameter_px from part p left join
 (select concat('P', s_suppkey) photo_id, (20+s_suppkey%9)::double d from supplier) c on c.photo_id=concat('P', cast(floor(p.p_partkey/20) as bigint))"""
)
def photo_circle_for_leaves(spark, sf):
    leaves = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), F.expr("cast(floor(p_partkey/20) as bigint)")).alias("photo_id"))
    circles = table(spark, sf, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("photo_id"), (20 + F.col("s_suppkey") % 9).cast("double").alias("diameter_px"))
    return J.photo_circle_to_leaves(leaves, circles)


# --- measurement tables -----------------------------------------------------------

_SCALES = "select concat(cast(o_orderkey as varchar(20)), '_leaf.png') image_name, case when o_orderkey%5=0 then cast(null as double) else cast((1+o_orderkey%7)/cast(1024 as double) as double) end cm2_per_px2 from orders"
_CM2 = f"""select f.image_name, f.frag, f.leaf_area_px, f.damage_px, s.cm2_per_px2, round_even(leaf_area_px*s.cm2_per_px2,4) leaf_area_cm2, round_even(damage_px*s.cm2_per_px2,4) damage_cm2
 from ({FRAGMENTS}) f left join ({_SCALES}) s on s.image_name=f.image_name"""
_ROLL = f"""select try_cast(nullif(regexp_extract(image_name,'^[0-9]+'),'') as bigint) photo_number, image_name, sum(leaf_area_px)::bigint leaf_area_px, sum(damage_px)::bigint damage_px,
 case when sum(leaf_area_px)>0 then round_even(sum(damage_px)/sum(leaf_area_px)*100.0,3) else 0 end damage_pct,
 round(sum(leaf_area_cm2),4) leaf_area_cm2, round(sum(damage_cm2),4) damage_cm2, coalesce(bool_or(leaf_area_cm2 is not null),false) has_cm2 from ({_CM2}) group by image_name"""


def _rolled(spark, sf):
    return M.rollup_images(M.with_cm2(sql(spark, sf, FRAGMENTS), sql(spark, sf, _SCALES)))


@query(_CM2)
def fragments_in_cm2(spark, sf):
    return M.with_cm2(sql(spark, sf, FRAGMENTS), sql(spark, sf, _SCALES))


@query(_ROLL)
def image_rollup(spark, sf):
    return _rolled(spark, sf)


@query(f"""select photo_number, image_name, 'cm2' unit, case when has_cm2 then leaf_area_cm2 else leaf_area_px::double end leaf_area, case when has_cm2 then damage_cm2 else damage_pct end damage from ({_ROLL})""")
def result_units(spark, sf):
    return M.unit_mode(_rolled(spark, sf))


@query(
    f"""select *, case when leaf_area_px>0 then round_even(damage_px/leaf_area_px*100.0,3) else 0 end fragment_pct,
 round_even(sum(damage_px) over (partition by image_name)/greatest(1,sum(leaf_area_px) over (partition by image_name))*100.0,3) image_pct from ({FRAGMENTS})"""
)
def weighted_image_damage(spark, sf):
    return M.weighted_damage(sql(spark, sf, FRAGMENTS))


@query(f"select *, row_number() over (partition by image_name order by leaf_area_px desc, frag, damage_px)::int rank from ({FRAGMENTS}) qualify rank=1")
def largest_fragment(spark, sf):
    f = sql(spark, sf, FRAGMENTS)
    from ..operators.components import first_by

    best = first_by(f, ["image_name"], -F.col("leaf_area_px"), F.col("frag"), F.col("damage_px"))
    return best.withColumn("rank", F.lit(1))


@query(
    f"""select image_name, frag, leaf_area_px, row_number() over (partition by image_name order by leaf_area_px desc, frag)::int rank
 from (select image_name, frag, max(leaf_area_px) leaf_area_px from ({FRAGMENTS}) group by 1,2)"""
)
def fragment_ranks(spark, sf):
    f = sql(spark, sf, FRAGMENTS).groupBy("image_name", "frag").agg(F.max("leaf_area_px").alias("leaf_area_px"))
    return M.rank_leaves(f)


_CIRC = """select concat('P', cast(l_orderkey as varchar(20))) image_id, cast(l_linenumber as int) method_rank, concat('m', cast(l_linenumber as varchar(20))) method,
 max(l_quantity) diameter_px, max(l_quantity*3) area_px, cast(max(round(l_discount*10)) as double)/2 score from lineitem group by l_orderkey, l_linenumber"""


_IMAGES = "select concat('P', cast(o_orderkey as varchar(20))) image_id from orders"


@query(
    f"""select image_id, method is not null found, method, diameter_px, area_px, score, coalesce(score<0.45, true) low_confidence, round(6.0/diameter_px,10) mm_per_px,
 round(pi()*9.0/area_px,10) mm2_per_px2 from ({_IMAGES}) left join (select * from ({_CIRC}) qualify row_number() over (partition by image_id order by score desc, method_rank)=1) using (image_id)"""
)
def best_reference_circle(spark, sf):
    out = M.best_circle(sql(spark, sf, _CIRC), sql(spark, sf, _IMAGES))
    return out.withColumn("mm_per_px", F.bround("mm_per_px", 10)).withColumn("mm2_per_px2", F.bround("mm2_per_px2", 10))


_CANDS = """select l_orderkey leaf_id, cast(l_linenumber-1 as int) priority, concat('c', cast(l_linenumber as varchar(20))) "name", max(cast(l_quantity as bigint)) area
 from lineitem group by l_orderkey, l_linenumber"""


@query(
    f"""with recursive c as (select *, row_number() over (partition by leaf_id order by priority) k from ({_CANDS})),
 f as (select leaf_id, k, "name" chosen, area from c where k=1
  union all select f.leaf_id, c.k, case when f.area>=30 or not (c.priority=1 or c.area>f.area) then f.chosen else c."name" end,
   case when f.area>=30 or not (c.priority=1 or c.area>f.area) then f.area else c.area end from f join c on c.leaf_id=f.leaf_id and c.k=f.k+1)
 select leaf_id, arg_max(chosen, k) chosen, arg_max(area, k) area from f group by leaf_id"""
)
def mask_fallback_choice(spark, sf):
    return M.choose_mask(sql(spark, sf, _CANDS.replace('"name"', "name")), 30)


@query(f"select image_id from ({SEG_META}) m where (not found or low_confidence) and image_id not in (select image_id from ({OVERRIDES}))")
def circle_review_list(spark, sf):
    return M.qc_low_confidence(sql(spark, sf, SEG_META), sql(spark, sf, OVERRIDES))


@query(
    """select count(*)::bigint n_images, count(*) filter (c_custkey%4<>0)::bigint n_detected, count(*) filter (c_custkey%6=1)::bigint n_manual,
 count(*) filter (c_custkey%7<>3)::bigint n_masks, count(*) filter (c_custkey%7=3)::bigint n_failed from customer"""
)
def run_counts(spark, sf):
    masks = sql(spark, sf, "select concat('P', cast(c_custkey as varchar(20))) image_id from customer where c_custkey%7<>3")
    return M.run_summary(sql(spark, sf, SEG_META), sql(spark, sf, OVERRIDES), masks)


_MANIFEST = """select l_shipdate, case cast(l_linenumber%5 as int) when 0 then 'nicks' when 1 then 'photo' when 2 then 'small' when 3 then 'large' else 'holes' end kind,
 case when l_suppkey%6=0 then 'id' else 'r90' end geom, cast(l_quantity/64 as double) damage_frac from lineitem"""


@query(f"select kind, count(*)::bigint n, avg(damage_frac) mean_frac, min(damage_frac) min_frac, max(damage_frac) max_frac from ({_MANIFEST}) where geom='id' group by kind")
def damage_by_kind(spark, sf):
    return M.summary_by_kind(sql(spark, sf, _MANIFEST))


@query("""select concat('L', cast(o_orderkey as varchar(20)), case when o_orderkey%3=0 then '_white_bg.png' else '.jpg' end) "name", o_orderkey%3=0 isolated from orders""")
def input_split(spark, sf):
    names = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20)), case when o_orderkey%3=0 then '_white_bg.png' else '.jpg' end) name from orders")
    done, todo = J.split_inputs(names)
    return done.withColumn("isolated", F.lit(True)).unionByName(todo.withColumn("isolated", F.lit(False)))


@query(
    """select concat('L', cast(o_orderkey as varchar(20)), '.png') "name", case when o_orderkey%2=0 then 'cut' else 'given' end origin from orders where o_orderkey%2=0 or o_orderkey%3=0"""
)
def output_merge(spark, sf):
    cut = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20)), '.png') name, 'cut' origin from orders where o_orderkey%2=0")
    given = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20)), '.png') name, 'given' origin from orders where o_orderkey%3=0")
    return J.merge_outputs(cut, given)


@query("select o_orderkey from orders order by md5(concat('7:', cast(o_orderkey as varchar))) limit 25")
def review_sample(spark, sf):
    return M.qc_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 25, 7)


@query(
    f"""with l as (select distinct expected_leaf_id leaf from ({TRAINING})), n as (select least(greatest(round_even(count(*)*0.1,0),1),count(*)-1) n_val from l),
 r as (select leaf, row_number() over (order by md5(concat('42:',leaf)), leaf) r from l)
 select t.dataset, t.stem, t.expected_leaf_id, r.leaf, case when r.r <= (select n_val from n) then 'val' else 'train' end split from ({TRAINING}) t join r on r.leaf=t.expected_leaf_id"""
)
def leaf_grouped_split(spark, sf):
    return M.split_by_leaf(sql(spark, sf, TRAINING))


@query("select concat('P', cast(o_orderkey as varchar(20))) photo_id from orders where o_orderkey%4<>1")
def photos_to_process(spark, sf):
    photos = sql(spark, sf, "select concat('P', cast(o_orderkey as varchar(20))) photo_id from orders")
    done = sql(spark, sf, "select concat('P', cast(o_orderkey as varchar(20))) photo_id from orders where o_orderkey%4=1")
    return M.unprocessed(photos, done)


_OLD = "select concat('P', cast(c_custkey as varchar(20)), '.png') image_name, cast(0 as bigint) damage_px, cast(c_custkey%9 as double) damage_pct from customer"


@query(f"select r.image_name, coalesce(u.damage_px, r.damage_px) damage_px, r.damage_pct from ({_OLD}) r left join (select image_name, arg_max(damage_px, seq) damage_px from ({EDITS}) group by 1) u on u.image_name=r.image_name")
def results_upsert(spark, sf):
    return M.upsert_results(sql(spark, sf, _OLD), sql(spark, sf, EDITS))


_ST = "select concat('L', cast(o_orderkey as varchar(20)), case when o_orderkey%2=0 then '_white_bg' else '' end) stem from orders"


@query(f"select 'masks' tbl, stem from ({_ST}) where (select 1) is not null and cast(regexp_extract(stem,'[0-9]+') as bigint)%7<>0 union all select 'edits' tbl, stem from ({_ST}) where cast(regexp_extract(stem,'[0-9]+') as bigint)%7<>0")
def output_purge(spark, sf):
    t = sql(spark, sf, _ST)
    gone = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20))) stem from orders where o_orderkey%7=0")
    kept = M.purge({"masks": t, "edits": t}, gone)
    return kept["masks"].withColumn("tbl", F.lit("masks")).unionByName(kept["edits"].withColumn("tbl", F.lit("edits")))


@query(
    """select concat('L', cast(o_orderkey as varchar(20))) leaf_id, case when o_orderkey%3=0 then 'new' else 'old' end ref, case when o_orderkey%3=0 then 'preview' else 'masks' end source from orders"""
)
def mask_promotion(spark, sf):
    new = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20)), case when o_orderkey%2=0 then '_white_bg' else '' end, '_leaf_mask') stem, 'new' ref from orders where o_orderkey%3=0")
    old = sql(spark, sf, "select concat('L', cast(o_orderkey as varchar(20))) leaf_id, 'old' ref from orders")
    return J.promote_masks(new, old)
