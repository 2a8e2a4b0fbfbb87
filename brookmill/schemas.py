"""Column types of the shop tables, all nullable."""

USER_VISIT_ACTION = (
    "date string, user_id long, session_id string, page_id long, action_time string, search_keyword string, "
    "click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, "
    "pay_category_ids string, pay_product_ids string, city_id long"
)
USER_INFO = "user_id long, username string, name string, age int, professional string, city string, sex string"
PRODUCT_INFO = "product_id long, product_name string, extend_info string"
CITY_INFO = "city_id long, city_name string, area string"
AD_CLICK = "ts timestamp, province string, city string, user_id long, ad_id long"

#: Patterns of the text forms.
DATE, TIME, DATE_KEY, MINUTE_KEY = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd", "yyyyMMddHHmm"
#: Reads hours with one digit or two.
TIME_READ = "yyyy-MM-dd H:mm:ss"
