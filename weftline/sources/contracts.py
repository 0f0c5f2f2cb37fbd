"""Schemas of what connectors deliver. Fetching and rendering are not done here: their rows are loaded."""

FETCH_RESPONSE = "url string, status int, final_url string, chain array<struct<status:int,url:string>>, headers map<string,string>, body binary, truncated boolean"
PAGE_STATUS = "url string, status int, final_url string, hops array<string>, body_len bigint, content_type string, content_length bigint, noindex boolean"
SITEMAP = "sitemap_url string, xml string"
FEED = "feed_url string, xml string"
STYLE_READING = (
    "page string, fonts array<string>, colors array<struct<value:string,n:int>>, roles map<string,struct<font:string,size:string,weight:string,lineHeight:string,letterSpacing:string,color:string,background:string>>, "
    "buttons array<struct<text:string,background:string,color:string,radius:string,font:string,weight:string,padding:string>>, logos array<struct<tag:string,src:string,alt:string,width:double,height:double>>"
)
LAYOUT_MEASURE = (
    "url string, width int, error string, overflow struct<px:int,element:string>, edges array<struct<x:int,bands:array<string>>>, "
    "small array<struct<px:double,element:string,text:string>>, tight array<struct<gap:int,side:string,panel:string,text:string>>"
)
REGISTRY = "key string, updated string, attrs map<string,string>"
#: Greatest bodies that are read, in bytes.
PAGE_BYTES, IMAGE_BYTES, VIDEO_BYTES, DOCUMENT_BYTES = 2_000_000, 25_000_000, 40_000_000, 25_000_000
#: Content types of documents that are converted.
STATE_VERSION = 2
